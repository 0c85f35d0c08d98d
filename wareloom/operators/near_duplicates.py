"""Near-duplicate entries by an exact set-similarity join; the first of each chain is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import union_rows
from ..functions.text import let, strip
from ..session import ensure_checkpoint_dir, staged


def shingles(text: Column, size: int, unit: str) -> Column:
    """Distinct hashed runs of `size` words or characters of a normalized text."""
    clean = strip(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))

    def runs(units: Column) -> Column:
        last = F.greatest(F.size(units) - size, F.lit(0))
        run = lambda i: F.xxhash64(*[F.get(units, i + k) for k in range(size)])
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), run))

    return let(F.split(clean, " " if unit == "word" else "(?!^)(?!$)"), runs)


#: Hash buckets over which tokens are counted, a byte each; more of them order the tokens better and cost the driver more.
BUCKETS = 1 << 16


def bucket_ranks(sets: DataFrame) -> bytes:
    """Per hash bucket a byte that grows with the logarithm of its tokens' count; BUCKETS bytes.

    The byte is 1 only if the bucket has one row: that token is in one set.
    """
    counts = (
        sets.select(F.explode("hashes").alias("token"))
        .groupBy(F.pmod("token", F.lit(BUCKETS)).cast("int").alias("bucket"))
        .agg((F.floor(F.log2(F.count(F.lit(1))) * 3) + 1).cast("int").alias("rank"))
        .toPandas()
    )
    ranks = bytearray(BUCKETS)
    for bucket, rank in zip(counts["bucket"].tolist(), counts["rank"].tolist()):
        ranks[bucket] = min(rank, 126)
    return bytes(ranks)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """id, size, token: the rarest tokens of each set (id, hashes) that another set may have.

    Two sets with a Jaccard similarity of at least `threshold` share a token
    among the first size - ceil(threshold * size) + 1 of each, in any common
    order. Rare ones come first, so a text with a template in common with many
    others meets these only where the template is nearly all of it. Tokens that
    are known to be in one set take up places but make no row. The top byte of
    a token is its rank, the rest is of its hash; where two tokens agree in all
    of that, a pair may be verified that need not be.
    """
    ranks = F.lit(bucket_ranks(sets))

    def ranked(token: Column) -> Column:
        rank = F.ascii(F.substring(ranks, F.pmod(token, F.lit(BUCKETS)).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), 56).bitwiseOR(token.bitwiseAND(F.lit((1 << 56) - 1)))

    size = F.size("hashes")
    most = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    first = F.slice(F.sort_array(F.transform("hashes", ranked)), F.lit(1), most)
    return sets.select("id", size.alias("size"), F.explode(first).alias("token")).where(F.shiftright("token", 56) > 1)


def _near_sizes(threshold: float) -> Column:
    """The length filter of a pair."""
    return F.least("size", "o_size") >= F.greatest("size", "o_size") * F.lit(threshold) - F.lit(1e-9)


def _shared_enough(threshold: float) -> Column:
    """The count filter of a pair whose prefixes have `shared` tokens in common.

    The prefix that ends first in the common order has all common tokens up to
    its end, and what follows it is all that can be shared beyond: one less
    than threshold * size. For sets of one size that asks for an eighth of
    their tokens where the threshold is 0.7.
    """
    need = F.ceil((F.col("size") + F.col("o_size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    rest = F.ceil(F.greatest("size", "o_size") * F.lit(threshold) - F.lit(1e-9)) - 1
    return F.col("shared") + rest >= need


#: Bits that tell which rows have an id of a list, before they are shuffled; more of them let fewer others through.
MARKS = 1 << 22


def _marks(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether an id may be one of `ids` (a column id): true for all of them, and for the few others with the same mark."""
    spark = ids.sparkSession

    def bit(i: Column) -> Column:
        return F.pmod(F.xxhash64(i), F.lit(MARKS))

    own = bit(F.col("id"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (own % 64).cast("int"))
    marks = ids.select((own / 64).cast("int").alias("w"), one.alias("bits"))
    none = spark.range(MARKS // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = union_rows(marks, none).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    table = words.agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("all"))  # MARKS / 64 rows, however many ids there are
    held = staged(table.select(F.transform("all", lambda s: s["bits"]).alias("bits")), "marks").select("bits").scalar()

    def marked(i: Column) -> Column:
        word = F.element_at(held, (bit(i) / 64).cast("int") + 1)
        return F.call_function("shiftright", word, (bit(i) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return marked


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (id, other) those that are similar: id, best (other, similarity) with the smallest other."""
    later = sets.where(_marks(pairs.select("id"))(F.col("id")))
    first = sets.where(_marks(pairs.select(F.col("other").alias("id")))(F.col("id")))
    both = pairs.join(later, "id").join(first.select(F.col("id").alias("other"), F.col("hashes").alias("other_hashes")), "other")
    common = F.size(F.array_intersect("hashes", "other_hashes"))
    whole = F.size("hashes") + F.size("other_hashes")
    held = both.select("id", "other", let(common, lambda c: c / (whole - c)).alias("similarity")).filter(F.col("similarity") >= threshold)
    return held.groupBy("id").agg(F.min_by(F.struct("other", "similarity"), "other").alias("best"))


def first_similar(sets: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """id, other, similarity: of each set (id, hashes) whose id is in `firsts` the smallest
    other < id with a Jaccard similarity of at least `threshold`; none for sets without one.

    `firsts` (id) has the smallest id of each group of equal sets; the others of
    the group are not looked for.

    Every set is held first against the sets that have the smallest id of many
    of its tokens. In the join of all entries only others below what that found
    are left, so a large group of near copies, which all have its first one,
    makes no pairs of its own there. Entries of a token that one set has end
    with the first shuffle, and only pairs that share enough of their prefixes
    get to the hashes.
    """
    of_token = W.partitionBy("token")
    met = prefixes(sets.where("id IS NOT NULL"), threshold).select(
        "*", F.min(F.struct("id", "size")).over(of_token).alias("o"), F.max("id").over(of_token).alias("last")
    )
    entries = staged(met.where("last > o.id").select("id", "size", "token", F.col("o.id").alias("o_id"), F.col("o.size").alias("o_size")), "prefixes")
    pair = ["id", "size", "o_id", "o_size"]
    counted = entries.where(F.expr("o_id < id") & _near_sizes(threshold)).groupBy(*pair).agg((2 * F.count(F.lit(1))).alias("shared"))  # a set before the two may have half of their tokens
    tried = staged(counted.where(_shared_enough(threshold)).select("id", F.col("o_id").alias("other")).distinct().join(firsts, "id", "left_semi"), "first-pairs")
    found = staged(_similar(tried, sets, threshold), "first-similar")

    # sets look for others below what they have found, copies for none; most sets have found none and are no copy
    copies = sets.select("id").where("id IS NOT NULL").distinct().join(firsts, "id", "left_anti")
    known = staged(union_rows(found.select("id", F.col("best.other").alias("below")), copies.select("id", F.lit(None).cast(found.schema["id"].dataType).alias("below"))), "known")
    marked = _marks(known.select("id"))(F.col("id"))
    rows = entries.select("id", "size", "token", F.col("o_id").alias("least"))
    maybe = rows.where(marked).join(known.withColumn("k", F.lit(True)), "id", "left").where("k IS NULL OR below IS NOT NULL").withColumn("below", F.coalesce("below", "id"))
    live = union_rows(rows.where(~marked).withColumn("below", F.col("id")), maybe.select("id", "size", "token", "least", "below")).repartition("token")
    others = live.select(F.col("token").alias("o_token"), F.col("id").alias("o_id"), F.col("size").alias("o_size"))
    shared = live.where("below > least").join(others, (F.col("token") == F.col("o_token")) & (F.col("o_id") < F.col("below")) & _near_sizes(threshold))
    counted = shared.groupBy(*pair).agg(F.count(F.lit(1)).alias("shared"))
    more = counted.where(_shared_enough(threshold)).select("id", F.col("o_id").alias("other")).distinct()
    more = staged(more.join(tried, ["id", "other"], "left_anti"), "more-pairs")
    best = union_rows(found, _similar(more, sets, threshold))
    return best.groupBy("id").agg(F.min_by("best", "best.other").alias("best")).select("id", "best.other", "best.similarity")


def followed(parents: DataFrame) -> DataFrame:
    """id, parent -> id, root: where the parents lead. Each round doubles the steps."""
    marked = parents.select("id", F.col("parent").alias("root")).checkpoint()
    mark = None
    while True:
        before, mark = mark, marked.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "root"))).first()
        if mark == before:
            return marked
        up = marked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        marked = marked.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root")).checkpoint()


def near_duplicates(
    items: DataFrame, threshold: float = 0.8, text: str = "text", size: int = 3, unit: str = "word"
) -> DataFrame:
    """Every item with the item that is kept for it: id, kept_id, similarity, is_duplicate.

    An item is a duplicate when an earlier item has a similarity of at least
    `threshold` with it; `similarity` is that with its first such item, and
    kept_id is the item without an earlier one that this leads to. No first
    similar item is missed, a pair is compared at most once, and the number of rounds grows with the
    logarithm of the longest chain. Items with equal sets are folded first.
    """
    ensure_checkpoint_dir(items.sparkSession)
    hashed = items.select("id", F.sort_array(shingles(F.col(text), size, unit)).alias("hashes"))
    # Two independent 64-bit hashes and the size stand for the whole set.
    set_key = F.concat_ws(":", F.xxhash64("hashes"), F.hash("hashes"), F.xxhash64(F.lit(1), "hashes"), F.size("hashes"))
    keyed = staged(hashed.withColumn("set_key", set_key), "shingles")
    copies = keyed.select("id", "set_key")
    firsts = staged(copies.groupBy("set_key").agg(F.min("id").alias("first_id")), "firsts")
    each = firsts.select(F.col("first_id").alias("id")).where("id IS NOT NULL").distinct()
    matched = (
        first_similar(keyed.select("id", "hashes"), each, threshold)
        .select(F.col("id").alias("first_id"), F.col("other").alias("parent"), "similarity")
        .checkpoint()
    )
    roots = followed(matched.select(F.col("first_id").alias("id"), "parent")).withColumnRenamed("id", "first_id")
    return (
        copies.join(firsts, "set_key")
        .join(matched.select("first_id", "similarity"), "first_id", "left")
        .join(roots, "first_id", "left")
        .select("id", F.coalesce("root", "first_id").alias("kept_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
        .withColumn("is_duplicate", F.col("id") != F.col("kept_id"))
    )
