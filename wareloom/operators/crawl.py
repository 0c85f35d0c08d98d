"""Bounded discovery over a stored link graph, and crawl reports."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.frames import union_rows
from ..session import ensure_checkpoint_dir, staged, work_folder


def crawl_graph(edges: DataFrame) -> DataFrame:
    """Canonical edges (src, dst) of the links a crawler may follow."""
    usable = edges.filter(U.crawl_skip_reason(F.col("link")) == "")
    return usable.select(
        U.canonical(F.col("url")).alias("src"), U.canonical(F.col("link")).alias("dst")
    ).distinct()


@dataclass
class StoredGraph:
    """The link graph and the stored pages as tables in buckets: joins on their keys move only the other side.

    links: src, dst, crawled (the link stands on a page that a crawler may
    visit), bucketed by src. pages: canonical, bucketed by canonical.
    """

    links: DataFrame
    pages: DataFrame
    buckets: int
    names: tuple[str, ...]

    def close(self) -> None:
        """Forget the table names; the files go with the work folder."""
        for name in self.names:
            self.links.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _bucketed(df: DataFrame, key: str, buckets: int, name: str) -> str:
    """Write a table, already hash partitioned by its key, with one file per bucket; its name."""
    table = f"{name}_{uuid.uuid4().hex}"
    folder = work_folder(df.sparkSession, name)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(table)
    return table


def store_graph(pages: DataFrame, edges: DataFrame, buckets: int | None = None) -> StoredGraph:
    """Write the graph once: one shuffle of the links by src, one of the pages by canonical url."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = (
        edges.filter(U.crawl_skip_reason(F.col("link")) == "")
        .select(
            U.canonical(F.col("url")).alias("src"),
            U.canonical(F.col("link")).alias("dst"),
            (U.crawl_skip_reason(F.col("url")) == "").alias("crawled"),
        )
        .repartition(buckets, "src")
        .groupBy("src", "dst")
        .agg(F.max("crawled").alias("crawled"))
    )
    stored = pages.select(U.canonical(F.col("url")).alias("canonical")).distinct().repartition(buckets, "canonical")
    names = (_bucketed(links, "src", buckets, "links"), _bucketed(stored, "canonical", buckets, "stored"))
    return StoredGraph(spark.table(names[0]), spark.table(names[1]), buckets, names)


def seed_pages(pages: DataFrame, graph: StoredGraph, order: str = "page_id") -> DataFrame:
    """canonical: where a crawl of stored pages starts.

    The first page of each host by `order`, and every page that no other page
    links to which a crawler may visit; such a page is found from nowhere else.
    """
    usable = pages.filter(U.crawl_skip_reason(F.col("url")) == "").withColumn("canonical", U.canonical(F.col("url")))
    usable = usable.filter("canonical IS NOT NULL")
    firsts = usable.groupBy(U.host(F.col("url")).alias("host")).agg(F.min_by("canonical", F.struct(order, "canonical")).alias("canonical"))
    linked = graph.links.filter("crawled AND src <> dst").select(F.col("dst").alias("canonical")).distinct()
    alone = usable.select("canonical").distinct().join(linked, "canonical", "left_anti")
    return union_rows(firsts.select("canonical"), alone).distinct()


def next_level(graph: StoredGraph, frontier: DataFrame, known: DataFrame) -> DataFrame:
    """canonical: urls linked from the frontier that are not known; the stored links are not shuffled.

    Targets fold to distinct urls before the shuffle, so a page that every page
    links to is one row per task there.
    """
    here = frontier.select(F.col("canonical").alias("src")).repartition(graph.buckets, "src")
    reached = graph.links.join(here, "src", "left_semi").select(F.col("dst").alias("canonical")).distinct()
    return reached.join(known, "canonical", "left_anti")


def discover(
    pages: DataFrame,
    edges: DataFrame,
    seeds: DataFrame | None = None,
    max_depth: int | None = None,
    max_pages: int | None = None,
    count_failed: bool = True,
) -> DataFrame:
    """Breadth-first pages from the seeds: canonical, depth, fetched.

    `seeds` has a url column; without it seed_pages() are taken. A url is
    visited once, at its smallest depth; without max_depth until no
    new url is found. Ties for the page cap go by (depth, canonical). Urls
    without a stored page count as failed; they use up the cap when
    count_failed is set, and are left out otherwise.

    One job per level; each level is written to the checkpoint folder, so a
    lost executor re-reads a file instead of walking the graph again. The graph
    is written once in buckets, which the levels join without moving it.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    graph = store_graph(pages, edges)
    stored = graph.pages.withColumn("fetched", F.lit(True))

    def looked_up(found: DataFrame, depth: int) -> DataFrame:
        how = "left" if count_failed else "inner"
        known = found.join(stored, "canonical", how)
        return known.select("canonical", F.lit(depth).alias("depth"), F.coalesce("fetched", F.lit(False)).alias("fetched"))

    if seeds is None:
        start = seed_pages(pages, graph)
    else:
        start = seeds.filter(U.crawl_skip_reason(F.col("url")) == "").select(U.canonical(F.col("url")).alias("canonical"))
    levels = [looked_up(start.distinct(), 0).checkpoint()]
    visited = levels[0].count()
    depth = 0
    while (max_depth is None or depth < max_depth) and (max_pages is None or visited < max_pages):
        depth += 1
        known = union_rows(*[level.select("canonical") for level in levels])
        level = looked_up(next_level(graph, levels[-1], known), depth).checkpoint()
        found = level.count()
        if found == 0:
            break
        levels.append(level)
        visited += found
    graph.close()
    out = union_rows(*levels)
    if max_pages is not None and visited > max_pages:
        out = out.orderBy("depth", "canonical").limit(max_pages)
    return out


def crawl_log(pages: DataFrame, edges: DataFrame, classified: DataFrame) -> DataFrame:
    """One row per crawl event (url, host, status, reason) from stored data.

    discovered: distinct link targets; skipped: pages with a skip reason;
    crawled / product: other pages; failed: link targets without a page.
    """
    url = F.col("url")
    tagged = pages.select("page_id", "url", U.crawl_skip_reason(url).alias("reason"))
    skipped = tagged.filter("reason <> ''").select("url", F.lit("skipped").alias("status"), "reason")
    kept = tagged.filter("reason = ''")
    crawled = kept.select("url", F.lit("crawled").alias("status"), "reason")
    products = kept.join(classified.filter("is_product").select("page_id"), "page_id", "left_semi").select(
        "url", F.lit("product").alias("status"), "reason"
    )
    # staged: of two readers the failed ones filter below the distinct, so the links would be read out twice
    targets = staged(edges.select(F.col("link").alias("url"), U.canonical(F.col("link")).alias("canonical")).distinct(), "targets")
    discovered = targets.select("url", F.lit("discovered").alias("status"), F.lit("").alias("reason"))
    stored = pages.select(U.canonical(url).alias("canonical"))
    failed = (
        targets.filter(U.crawl_skip_reason(url) == "")
        .join(stored, "canonical", "left_anti")
        .select("url", F.lit("failed").alias("status"), F.lit("").alias("reason"))
    )
    log = union_rows(discovered, skipped, crawled, products, failed)
    return log.select("url", U.host(url).alias("host"), "status", "reason")


def crawl_stats(log: DataFrame) -> DataFrame:
    """Event counts per host and status, with totals (NULL = all)."""
    return log.rollup("host", "status").agg(F.count(F.lit(1)).alias("n"))


def _count(status: str):
    return F.count_if(F.col("status") == status)


def crawl_report(log: DataFrame) -> DataFrame:
    """Crawl totals and rates in percent, safe for an empty log."""
    totals = log.agg(
        _count("discovered").alias("total_discovered"),
        _count("crawled").alias("total_crawled"),
        _count("skipped").alias("total_skipped"),
        _count("failed").alias("total_failed"),
        _count("product").alias("products_found"),
    )

    def rate(part: str, whole: str):
        return F.col(part) / F.greatest(F.col(whole), F.lit(1)) * 100

    return totals.select(
        "*",
        rate("products_found", "total_crawled").alias("product_rate"),
        rate("total_skipped", "total_discovered").alias("skip_rate"),
        rate("total_failed", "total_crawled").alias("failure_rate"),
    )
