"""Approximate nearest neighbours by cosine: NN-descent builds a graph, queries walk it greedily.

Equal vectors are one node of the graph, which keeps the few smallest ids that
any answer can need. The first lists come from blocks: nodes sorted by the bits
of their sides to random planes, cut every `LEAF` nodes, several times with
other planes. Each round then joins every node's neighbours, forward and
backward, with their vectors, compares neighbours of one node with each other
where one of the two is new, and keeps the nearest of old and proposed ones;
rounds end when few lists change. A query starts at the node of its own vector,
if the graph has it, and at the nearest of a fixed sample of nodes; it expands
the nearest nodes that it hasn't yet, many queries at once, until (nearly) all
of the best `BEAM` are expanded. Those are scored exactly, in double precision, on the
original vectors.

Everything sized by the table moves by joins and shuffles; a list, a block and
a beam have fixed bounds, which are what makes the search approximate. Only
the plane and entry samples, fixed in number per vector length, are closures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wareloom.functions.frames import union_rows
from wareloom.llm.common import whole_groups
from wareloom.session import staged

#: Nodes in a list; backward neighbours taken besides; proposals per node and neighbourhood.
NEIGHBOURS, BACKWARD, PROPOSALS = 32, 24, 12
#: Trees of blocks, planes of each, nodes of a block, edges that a node gets from one.
TREES, PLANES, LEAF, LEAF_EDGES = 8, 24, 1024, 16
ROUNDS, ENOUGH = 6, 0.08
#: Nodes that a query keeps, expands at once, and may start from.
BEAM, EXPAND, ENTRIES, STARTS = 128, 32, 512, 4
#: The walk ends when so small a share of the kept nodes is not expanded yet.
UNEXPANDED = 0.001

Frames = Iterator[pd.DataFrame]


@dataclass
class Graph:
    """nodes: node, dims, unit, vector, ids. adjacency: node, near."""

    nodes: DataFrame
    adjacency: DataFrame


def usable(vector: Column) -> Column:
    """Not null, with a component, all components finite and not all zero."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda c: c != 0)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that puts the largest component near 1: exact, and squares stay finite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _pack(frames: Frames) -> Frames:
    """Adds dims and unit: the direction in half precision, as bytes, to compare nodes while the graph grows."""
    for frame in frames:
        size = frame["vector"].map(len)
        for dims, part in frame.groupby(size):
            v = _scaled(np.stack(part["vector"].to_numpy()).astype(np.float64))
            unit = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float16)
            yield part.assign(dims=dims, unit=[u.tobytes() for u in unit])


def _units(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1).astype(np.float32)


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """vec_id, embedding -> node, ids, vector, dims, unit: one row per distinct usable vector.

    ids are the `keep` smallest ids that have the vector. Rows without an id take no part.
    """
    rows = vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["id", "vector"])
    first = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    folded = (
        rows.withColumn("nth", first)
        .where(F.col("nth") <= keep)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("node"), "ids", "vector")
    )
    kind = f"node long, ids {folded.schema['ids'].dataType.simpleString()}, vector array<double>, dims int, unit binary"
    return staged(folded.mapInPandas(_pack, kind), "neighbour-nodes")


def _sampled(nodes: DataFrame, rows: int, seed: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length the ids and units of up to `rows` nodes, drawn by hash of the vector."""
    nth = F.row_number().over(W.partitionBy("dims").orderBy(F.xxhash64(F.lit(seed), "unit"), "node"))
    some = nodes.select("node", "dims", "unit", nth.alias("nth")).where(F.col("nth") <= rows).orderBy("dims", "nth").toPandas()
    return {d: (p["node"].to_numpy(), _units(p["unit"])) for d, p in some.groupby("dims")}


def _sides(planes: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Frames], Frames]:
    """One row per node and tree; the key has a bit per plane, which stands between two sampled nodes."""

    def run(frames: Frames) -> Frames:
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                sample, u = planes[dims][1], _units(part["unit"])
                for tree in range(TREES):
                    draw = np.random.default_rng(tree).integers(len(sample), size=(2, PLANES))
                    normal, middle = sample[draw[0]] - sample[draw[1]], (sample[draw[0]] + sample[draw[1]]) / 2
                    bits = u @ normal.T > (normal * middle).sum(axis=1)
                    key = bits @ (1 << np.arange(PLANES)[::-1])
                    yield pd.DataFrame({"tree": tree, "dims": dims, "key": key, "node": part["node"], "unit": part["unit"]})

    return run


def _nearest(src: np.ndarray, dst: np.ndarray, s: np.ndarray, most: int) -> pd.DataFrame:
    """For each row of s its best `most` columns above -2 as edges."""
    top = np.argpartition(-s, min(most, s.shape[1]) - 1, axis=1)[:, :most]
    sim = np.take_along_axis(s, top, axis=1)
    row, col = np.nonzero(sim > -2)
    return pd.DataFrame({"src": src[row], "dst": dst[top[row, col]], "sim": sim[row, col]})


def _similar(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cosines, rounded so that one pair has one value wherever it is compared."""
    return np.round(u @ w.T, 6)


def _within_blocks(frames: Frames) -> Frames:
    """Each block's nodes with the nearest others of the block; blocks are cut as the sorted rows come."""
    for frame in whole_groups(_blocks(frames), ["tree", "dims", "cut"]):
        for _, block in frame.groupby(["tree", "dims", "cut"]):
            u, node = _units(block["unit"]), block["node"].to_numpy()
            s = _similar(u, u)
            np.fill_diagonal(s, -2)
            yield _nearest(node, node, s, LEAF_EDGES)


def _blocks(frames: Frames) -> Frames:
    """Numbers the blocks: LEAF rows each, from the start of a tree (or of its rows in this task)."""
    at, last = 0, None
    for frame in frames:
        cuts = np.empty(len(frame), np.int64)
        for key, where in sorted(frame.groupby(["tree", "dims"]).indices.items()):
            at = at if key == last else 0
            cuts[where] = (at + np.arange(len(where))) // LEAF
            at, last = at + len(where), key
        yield frame.assign(cut=cuts)


def _first_of(most: int) -> Callable[[Frames], Frames]:
    """Of rows sorted by src and falling sim: every dst once, the first `most` of a src, numbered."""

    def run(frames: Frames) -> Frames:
        for frame in whole_groups(frames, ["src"]):
            once = frame.drop_duplicates(["src", "dst"])
            nth = once.groupby("src").cumcount()
            yield once.assign(nth=nth)[nth < most]

    return run


def _kept(edges: DataFrame, most: int) -> DataFrame:
    """The nearest `most` dst of each src, numbered from 0; of two rows of a pair the one that is not fresh."""
    ordered = edges.select("src", "dst", "sim", "fresh").repartition("src").sortWithinPartitions("src", F.desc("sim"), "dst", "fresh")
    return ordered.mapInPandas(_first_of(most), "src long, dst long, sim float, fresh boolean, nth int")


def _backward(edges: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """edges turned round, at most `most` per node; a hub's are cut before the shuffle."""
    place = F.row_number().over(W.partitionBy("dst").orderBy(*order, "src"))
    return edges.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _compare(frames: Frames) -> Frames:
    """Within each node's neighbourhood the pairs with a new member that beat what a node has."""
    for frame in whole_groups(frames, ["at"]):
        units, near = _units(frame["unit"]) if frame["dims"].nunique() == 1 else None, frame["near"].to_numpy()
        fresh, bound = frame["fresh"].to_numpy(), frame["bound"].to_numpy()
        found = []
        for where in frame.groupby("at", sort=False).indices.values():
            u = units[where] if units is not None else _units(frame["unit"].iloc[where])
            s = _similar(u, u)
            np.fill_diagonal(s, -2)
            s[~(fresh[where][:, None] | fresh[where][None, :]) | (s <= bound[where][:, None])] = -2
            if (s > -2).any():
                found.append(_nearest(near[where], near[where], s, PROPOSALS))
        if found:
            yield pd.concat(found, ignore_index=True).assign(fresh=True)


def _descend(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One round: edges -> edges, fresh for those that are new."""
    ahead = edges.select(F.col("src").alias("at"), F.col("dst").alias("near"), "fresh")
    back = _backward(edges, BACKWARD, [F.desc("fresh"), F.xxhash64("src", "dst")]).select(F.col("dst").alias("at"), F.col("src").alias("near"), "fresh")
    own = nodes.select(F.col("node").alias("at"), F.col("node").alias("near"), F.lit(False).alias("fresh"))
    around = union_rows(ahead, back, own).repartition("near").groupBy("at", "near").agg(F.max("fresh").alias("fresh"))
    bound = edges.where(F.col("nth") == NEIGHBOURS - 1).select("src", F.col("sim").alias("bound"))  # of full lists
    known = nodes.select("node", "dims", "unit").join(bound, F.col("node") == F.col("src"), "left")
    known = known.select(F.col("node").alias("near"), "dims", "unit", F.coalesce("bound", F.lit(-2.0)).cast("float").alias("bound"))
    met = around.join(known, "near").repartition("at").sortWithinPartitions("at", "near")
    proposed = met.mapInPandas(_compare, "src long, dst long, sim float, fresh boolean")
    return _kept(union_rows(edges.select("src", "dst", "sim", F.lit(False).alias("fresh")), proposed), NEIGHBOURS)


def build(vectors: DataFrame, keep: int = 6) -> Graph:
    """The neighbour graph over the usable rows of vec_id, embedding (others are left out).

    Vectors of different lengths are never neighbours. An empty table gives an empty graph.
    """
    nodes = nodes_of(vectors, keep)
    blocks = (
        nodes.mapInPandas(_sides(_sampled(nodes, 256, "planes")), "tree int, dims int, key long, node long, unit binary")
        .repartitionByRange("tree", "dims", "key", "node")
        .sortWithinPartitions("tree", "dims", "key", "node")
    )
    edges = blocks.mapInPandas(_within_blocks, "src long, dst long, sim float").withColumn("fresh", F.lit(True))
    edges = staged(_kept(edges, NEIGHBOURS), "neighbour-lists")
    for _ in range(ROUNDS):
        edges = staged(_descend(nodes, edges), "neighbour-lists")
        total, fresh = edges.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if fresh <= ENOUGH * total:
            break
    ends = edges.select("src", "dst")
    back = _backward(edges, BACKWARD, [F.desc("sim")]).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    adjacency = union_rows(ends, back).groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("near"))
    return Graph(nodes, staged(adjacency, "neighbour-graph"))


def _starts(entries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Frames], Frames]:
    """Each query's nearest sampled nodes."""

    def run(frames: Frames) -> Frames:
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                if dims in entries:
                    node, u = entries[dims]
                    found = _nearest(part["query"].to_numpy(), node, _similar(_units(part["q_unit"]), u), STARTS)
                    yield found.rename(columns={"src": "query", "dst": "node"})

    return run


#: A kept node of a query: done when expanded, open when it is expanded next.
BEAM_ROW = "query long, node long, sim float, done boolean, open boolean"


def _advance(frames: Frames) -> Frames:
    """One query after the other: its own row (node -1, unit only), kept nodes (sim only) and reached ones (node and unit) make its next beam."""
    for frame in whole_groups(frames, ["query"]):
        for query, where in frame.groupby("query", sort=False).indices.items():
            part = frame.iloc[where]
            own = part["node"] < 0
            new = part["sim"].isna() & ~own
            kept = part[part["sim"].notna()]
            new = part[new].drop_duplicates("node")
            new = new[~new["node"].isin(kept["node"])]
            sim = np.empty(0, np.float32)
            if len(new):
                sim = _similar(_units(new["unit"]), _units(part["unit"][own])).ravel()
            beam = pd.DataFrame(
                {
                    "node": np.concatenate([kept["node"], new["node"]]).astype(np.int64),
                    "sim": np.concatenate([kept["sim"], sim]).astype(np.float32),
                    "done": np.concatenate([kept["done"], np.zeros(len(new))]).astype(bool),
                }
            )
            beam = beam.sort_values(["sim", "node"], ascending=[False, True]).drop_duplicates("node").iloc[:BEAM]
            left = ~beam["done"]
            yield beam.assign(query=query, open=left & (left.cumsum() <= EXPAND))


def _next_beam(asked: DataFrame, kept: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """All that belongs to a query in one task: one shuffle a round."""
    none = F.lit(None)
    parts = [
        asked.select("query", F.lit(-1).cast("long").alias("node"), none.cast("float").alias("sim"), F.lit(False).alias("done"), F.col("q_unit").alias("unit")),
        kept.select("query", "node", "sim", "done", none.cast("binary").alias("unit")),
    ]
    if reached is not None:
        parts.append(reached.select("query", "node", none.cast("float").alias("sim"), F.lit(False).alias("done"), "unit"))
    ordered = union_rows(*parts).repartition("query").sortWithinPartitions("query", "node")
    return staged(ordered.mapInPandas(_advance, BEAM_ROW), "neighbour-beam")


def _walk(graph: Graph, asked: DataFrame, starts: DataFrame) -> DataFrame:
    """query, node, sim, done, open: the beams when (nearly) all of their nodes are expanded.

    A round moves what is expanded to the lists, what these reach to the
    vectors, and those with the kept nodes to the query.
    """
    units = graph.nodes.select("node", "unit")
    beam = _next_beam(asked, starts.withColumn("done", F.lit(False)))
    while True:
        total, left = beam.agg(F.count(F.lit(1)), F.count_if("open")).first()
        if left <= UNEXPANDED * total:
            return beam
        reached = beam.where("open").select("query", "node").join(graph.adjacency, "node").select("query", F.explode("near").alias("node"))
        reached = reached.repartition("node").dropDuplicates(["query", "node"]).join(units, "node")
        kept = beam.withColumn("done", F.col("done") | F.col("open"))
        beam = _next_beam(asked, kept, reached)


def _score(frames: Frames) -> Frames:
    """Cosine of the original vectors in double precision."""
    for frame in frames:
        score = np.empty(len(frame))
        for where in frame.groupby(frame["vector"].map(len)).indices.values():
            a, b = (_scaled(np.stack(frame[c].iloc[where].to_numpy())) for c in ("q_vector", "vector"))
            score[where] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        yield pd.DataFrame({"query": frame["query"], "ids": frame["ids"], "score": score})


def search(graph: Graph, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `k` nearest found rows with another id.

    `queries` has query_id (of the type of vec_id) and embedding; unusable ones
    give no row. Nearest first, ties to the smaller vec_id. Rows of one id with
    several vectors are one candidate with its best score, and one query that
    is near to what is near to any of them. Repeated rows count once. The graph must
    keep at least k + 1 ids per node (`build(keep=...)`).
    """
    rows = queries.select(F.col("query_id").alias("vec_id"), "embedding")
    asked = nodes_of(rows, 1).select(F.col("node").alias("query"), F.col("vector").alias("q_vector"), "dims", F.col("unit").alias("q_unit"))
    asks = rows.select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda c: c.cast("double")).alias("q_vector"))
    asks = staged(asks.where("query_id is not null").distinct().join(asked, "q_vector").select("query_id", "query"), "neighbour-asks")

    entries = asked.mapInPandas(_starts(_sampled(graph.nodes, ENTRIES, "entries")), "query long, node long, sim float")
    own = asked.join(graph.nodes.select("node", "vector"), F.col("q_vector") == F.col("vector"))
    own = own.select("query", "node", F.lit(1.0).cast("float").alias("sim"))
    beam = _walk(graph, asked.select("query", "q_unit"), union_rows(own, entries))

    pairs = beam.select("query", "node").join(graph.nodes.select("node", "ids", "vector"), "node").join(asked.select("query", "q_vector"), "query")
    ids = graph.nodes.schema["ids"].dataType.simpleString()
    scored = pairs.select("query", "ids", "vector", "q_vector").mapInPandas(_score, f"query long, ids {ids}, score double")
    best = scored.select("query", F.explode("ids").alias("vec_id"), "score").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    nearest_first = [F.desc("score"), "vec_id"]
    # one more than asked for: the query's own id is taken out after the copies of a query are told apart
    best = best.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(*nearest_first))).where(F.col("nth") <= k + 1)
    answers = asks.join(best, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*nearest_first))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
