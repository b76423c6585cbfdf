"""Mixing sources to target weights (native expressions only).

Every source is a stream of words: its documents in a permuted order, passed as
often as the target asks for. The stream is cut into blocks of equal words, and
the target fixes the source's exact quota of blocks. A binary tree splits the
quotas among the output shards: at each node half of the quota units, drawn
without replacement, go left, so the counts by source of either half follow a
multivariate hypergeometric law and stay exact. A leaf then draws its quota of
every source's permuted blocks, disjoint from all other leaves, and shuffles its
documents locally.

The quota units number ``shards * units`` plus one per source. A shard is as many
tasks as its words ask for, so the tree's size and a task's are both bounded whatever
the size of the corpus; the ranges in which prefix sums run hold RANGE_ROWS documents
on average.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pathshade.llm.ship import unused
from pathshade.session import written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of a leaf, but for there being no more than LEAVES of these; words a task lays out.
LEAF_WORDS, LEAVES, TASK_WORDS = 1 << 20, 1 << 12, 1 << 18
RANGE_ROWS = 1 << 11


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size) -> also rank and target.

    Sources by code point, null last, take the weights in turn. They share
    ``share`` times all sizes; no target exceeds ``most`` times its source's
    size, the excess is reshared by weight. Ordered by cap / weight the capped
    sources are a prefix, so one pass of prefix sums finds the water level.
    """
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.pmod("rank", F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = W.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levelled = ranked.withColumns({"left": left, "rest": rest, "at": F.row_number().over(order)})
    capped = F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left")
    free = F.min(F.when(~capped, F.struct("at", "left", "rest"))).over(whole)
    levelled = levelled.withColumn("free", free)
    below = F.col("free").isNull() | (F.col("at") < F.col("free.at"))
    return levelled.select("source", "n", "source_size", "rank", F.when(below, F.col("cap")).otherwise(F.col("weight") * F.col("free.left") / F.col("free.rest")).alias("target"))


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(rank, blocks) -> (rank, shard, first, quota): each shard's run of the
    source's permuted blocks, from the splitting tree of 2**depth leaves."""
    units = quotas.where("blocks > 0").select("rank", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("unit"), F.lit(0).alias("node"))
    for level in range(depth):
        draw = W.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "rank", "unit"), "rank", "unit")
        right = F.row_number().over(draw) > F.floor(F.count(F.lit(1)).over(W.partitionBy("node")) / 2)
        units = units.select("rank", "unit", (F.col("node") * 2 + right.cast("int")).alias("node"))
    leaves = units.groupBy("rank", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))
    before = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    return leaves.withColumn("first", F.sum("quota").over(before) - F.col("quota"))


def layout(words: float) -> tuple[int, int]:
    """Depth of the tree, and tasks a leaf, for a mix of so many words."""
    leaves = min(LEAVES, max(1, math.ceil(words / LEAF_WORDS)))
    depth = math.ceil(math.log2(leaves))
    return depth, max(1, math.ceil(words / TASK_WORDS / (1 << depth)))


def identity() -> list[Column]:
    """Two hashes that with doc_id name a document."""
    return [F.xxhash64("doc_id", "source", "text").alias("digest"), F.hash("text", "source").alias("check")]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, depth: int | None = None, units: int = 64, buckets: int | None = None, seed: int = 20) -> DataFrame:
    """One row per document and pass: doc_id, source, digest, check, copy, size,
    source_size, target, pass, words, shard, position, task.

    Reads doc_id, source and text of ``docs``. ``words`` of the document are
    taken in that pass, its leading ones (all but at the end of a source's
    quota); a document that the mix does not take has one row of pass 0, no
    words and no shard. Null texts have size 0, a null source is a source of its
    own, repeated rows are documents of their own, numbered by ``copy`` among
    those equal in doc_id and two hashes of all three columns. Empty tables give no rows.
    Reruns agree. Other columns are not looked at, whatever their names.

    A hot source is spread over ``buckets`` ranges of its permutation; prefix sums
    run in each range and over the ranges' totals.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    skinny = written(docs.select("doc_id", "source", size.alias("size"), *identity()), "mix")
    if buckets is None:
        buckets = max(1, math.ceil(skinny.count() / RANGE_ROWS))
    skinny = skinny.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "digest"), F.lit(buckets)))
    by_range = skinny.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    by_range = written(by_range, "mix-ranges")
    asked, tasks = layout(share * (by_range.agg(F.sum("words")).first()[0] or 0))
    depth = asked if depth is None else depth
    aims = targets(by_range.groupBy("source").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size")), weights, share, most)
    block = F.greatest(F.lit(1.0), F.ceil(F.sum("target").over(W.partitionBy()) / (units << depth)).cast("double"))
    aims = aims.withColumn("block", block).withColumn("quota_words", F.round("target").cast("long"))
    aims = written(aims.withColumn("blocks", F.ceil(F.col("quota_words") / F.col("block")).cast("long")), "mix-targets")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranges = by_range.withColumn("start", F.sum("words").over(before) - F.col("words"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranges = ranges.join(aims, same(ranges, aims)).select(ranges["source"], ranges["bucket"], "start", "source_size", "rank", "target", "quota_words", "block")

    placed = skinny.join(ranges, same(skinny, ranges) & (skinny["bucket"] == ranges["bucket"])).select(skinny["*"], "start", "source_size", "rank", "target", "quota_words", "block")
    order = W.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), "digest"), "digest", "doc_id")
    equal = W.partitionBy("source", "bucket", "digest", "check", "doc_id").orderBy("digest")
    at = F.col("start") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("at", at).withColumn("copy", F.row_number().over(equal))
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) - 1).cast("int")))
    pieces = placed.withColumn("pass", F.explode(passes)).withColumn("offset", F.col("at") + F.col("pass") * F.col("source_size"))
    words = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("quota_words") - F.col("offset")))
    pieces = pieces.withColumn("words", words).where("words > 0 or pass = 0").withColumn("unit", F.floor(F.col("offset") / F.col("block")))

    runs = split_tree(aims.select("rank", "blocks"), depth, seed)
    numbered = aims.where("blocks > 0").select("rank", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("unit"))
    permuted = numbered.withColumn("turn", F.row_number().over(W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "unit"), "unit")) - 1)
    turns = runs.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("turn"))
    drawn = written(permuted.join(turns, ["rank", "turn"]).select("rank", "unit", "shard"), "mix-blocks")

    on = (pieces["rank"] == drawn["rank"]) & (pieces["unit"] == drawn["unit"]) & (pieces["words"] > 0)
    out = pieces.join(drawn, on, "left")  # the blocks of a source are many keys
    out = out.withColumn("words", F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("position", F.xxhash64(F.lit(seed + 3), "digest", "check", "copy", "pass"))
    task = F.pmod("position", F.lit(tasks)).cast("int")
    return out.select("doc_id", "source", "digest", "check", "copy", "size", "source_size", "target", "pass", "words", "shard", "position", task.alias("task"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = mix(docs, **options)
    out = rows.groupBy("source", "digest", "check", "copy", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with rows repeated or left out as it says, in
    shards whose rows are in shuffled order. The document at the end of a
    source's quota keeps its leading words. Null texts have no words and are left out,
    an empty table gives no rows, columns may have any names."""
    names = ("digest", "check", "copy", "size", "words", "shard", "position", "task", "doc_id")
    digest, check, copy, size, words, shard, position, task, own_id = new = unused(docs, *[f"_mix_{n}" for n in names])
    rows = mix(docs, **options).where("words > 0").select(*[F.col(n).alias(x) for n, x in zip(names, new, strict=True)])
    own, own_check, own_copy = unused(docs, "_own_digest", "_own_check", "_own_copy")
    # one shuffle of the texts, by the first hash, serves the numbering and the join: the rest of
    # the identity is compared in a form that is no join key
    keyed = docs.withColumns(dict(zip((own, own_check), identity(), strict=True))).repartition(own)
    keyed = keyed.withColumn(own_copy, F.row_number().over(W.partitionBy(own, own_check, "doc_id").orderBy(own)))
    same = lambda a, b: F.coalesce(F.col(a).cast("long"), F.lit(0)).bitwiseXOR(F.coalesce(F.col(b).cast("long"), F.lit(0))) == 0
    whole = keyed.join(rows, (F.col(own) == F.col(digest)) & same(own_check, check) & same("doc_id", own_id) & same(own_copy, copy))
    cut = F.col(words) < F.col(size)
    leading = F.array_join(F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), "")
    out = whole.withColumn("text", F.when(cut, leading).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.repartition(shard, task).sortWithinPartitions(shard, task, position).select(docs.columns)
