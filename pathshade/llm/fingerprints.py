"""Homomorphic multiset fingerprints of documents (native expressions only).

A text is a multiset of paragraphs (its lines). Each paragraph gives a wide
vector; the text's fingerprint is their sum, lane by lane, modulo a power of
two. Sums commute, so the order of paragraphs does not matter, equal multisets
are equal lane by lane, and a paragraph is inserted or deleted by adding or
subtracting its vector (``combined``). The vector has three parts:

* EXACT_LANES lanes modulo 2**EXACT_BITS: a hash of the whole paragraph under one
  seed each, 294 bits that decide equality;
* one lane modulo 2**32: the number n of the paragraph's word pairs;
* LANES sketch lanes modulo 2**32: each of the paragraph's word pairs is hashed to
  a vector of bits. A lane of c set bits reads as 2c - n, a sum of random signs, so the
  normalised inner product of two fingerprints estimates the likeness of the texts
  as multisets of word pairs (standard error about 1 / sqrt(LANES)). No text is long
  enough for a lane to wrap.

The bits of one hash are counted three at a time: lanes 21 bits apart share one
long sum, which is split before 2**21 rows could carry into the next lane.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

EXACT_LANES, SEEDS, SHIFTS = 7, 4, 21
EXACT_BITS = 42
LANES = SEEDS * SHIFTS * 3
SPREAD = (1 << 42) | (1 << 21) | 1
#: Rows of a range of doc_id, on average, and the quantiles between which ranges are cut (squared).
ROWS_A_BUCKET, CUTS = 256, 16


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys -> exact array<bigint>, n bigint, lanes array<bigint>.

    ``keys`` name a row. If the input is partitioned by some of them nothing is
    shuffled. A null text counts as empty; an empty paragraph is a paragraph.
    """
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_line"))
    words = lines.select(*keys, "_line", F.split("_line", "[\\x20\\x09-\\x0D]+", -1).alias("_w"))
    pairs = words.select(*keys, "_line", "_w", F.posexplode("_w").alias("_pos", "_a"))
    after = F.coalesce(F.get("_w", F.col("_pos") + 1), F.lit(""))  # every word starts a pair
    hashed = pairs.select(
        *keys,
        F.shiftright(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), 19).alias("_chunk"),
        *[F.xxhash64(F.lit(s), "_a", after).alias(f"_h{s}") for s in range(SEEDS)],
        *[F.when(F.col("_pos") == 0, F.xxhash64(F.lit(101 + j), "_line").bitwiseAND((1 << EXACT_BITS) - 1)).otherwise(0).alias(f"_e{j}") for j in range(EXACT_LANES)],
    )
    packed = hashed.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_e{j}").alias(f"_x{j}") for j in range(EXACT_LANES)],
        *[F.sum(F.shiftrightunsigned(f"_h{s}", b).bitwiseAND(SPREAD)).alias(f"_s{s}_{b}") for s in range(SEEDS) for b in range(SHIFTS)],
    )
    lanes = [F.shiftrightunsigned(f"_s{s}_{b}", 21 * i).bitwiseAND((1 << 21) - 1) for s in range(SEEDS) for b in range(SHIFTS) for i in range(3)]
    low, high = lanes[::2], lanes[1::2] + [F.lit(0).cast("long")] * (LANES % 2)
    chunks = packed.select(*keys, "_n", *[F.col(f"_x{j}").bitwiseAND((1 << EXACT_BITS) - 1).alias(f"_x{j}") for j in range(EXACT_LANES)], *[(a + F.shiftleft(b, 31)).alias(f"_p{i}") for i, (a, b) in enumerate(zip(low, high, strict=True))])
    sums = chunks.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in chunks.columns if c[:2] in ("_x", "_p")])
    lane = lambda i: (F.shiftrightunsigned(f"_p{i // 2}", 31) if i % 2 else F.col(f"_p{i // 2}")).bitwiseAND((1 << 31) - 1)
    return sums.select(
        *keys,
        F.array(*[F.col(f"_x{j}").bitwiseAND((1 << EXACT_BITS) - 1) for j in range(EXACT_LANES)]).alias("exact"),
        F.pmod("_n", F.lit(1 << 32)).alias("n"),
        F.array(*[lane(i) for i in range(LANES)]).alias("lanes"),
    )


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Insert (sign 1) or delete (sign -1) the paragraphs of fingerprint b: both
    are structs of exact, n and lanes."""
    mod = lambda x, y, m: F.pmod(x + F.lit(sign) * y, F.lit(m))
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: mod(x, y, 1 << EXACT_BITS)).alias("exact"),
        mod(a["n"], b["n"], 1 << 32).alias("n"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: mod(x, y, 1 << 32)).alias("lanes"),
    )


def as_hex(f: Column) -> Column:
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(f["exact"], lambda x: digits(x, 11)), ""), digits(f["n"], 8), F.array_join(F.transform(f["lanes"], lambda x: digits(x, 8)), ""))


def signed(f: Column) -> Column:
    """The lanes as sums of signs: 2c - n, read modulo 2**33 around 0."""
    return F.transform(f["lanes"], lambda c: (F.pmod(c * 2 - f["n"] + (1 << 32), F.lit(1 << 33)) - (1 << 32)).cast("double"))


def likeness(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Estimated cosine of two multisets of word pairs from their signed lanes, 0 to 1."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda x, y: x + y)
    return F.when((norm_a == 0) | (norm_b == 0), zero).otherwise(F.least(F.lit(1.0), F.greatest(zero, dot / F.sqrt(norm_a * norm_b))))


def ranges(docs: DataFrame) -> tuple[Column, int]:
    """The range (bucket) of a row of (doc_id, h, text), and the span of numbers that the
    ranges between two quantiles share: higher ones hold larger ids, null ids have negative ones. Quantiles of doc_id cut the table, equal widths cut what
    lies between two, so an outlying id does not matter; an id that several
    quantiles share, and null, are cut by h, which orders the rows of one id."""
    at = [i / CUTS**2 for i in range(CUTS**2 + 1)]
    rows, nulls, found = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", at, 40 * CUTS**2)).first()
    needed = lambda n: max(1, math.ceil(n / ROWS_A_BUCKET))
    cut_by_h = lambda n: F.floor(F.col("h") * n / (1 << 31))
    none = (-1 - cut_by_h(F.lit(needed(nulls)))) if nulls else F.lit(-1)
    cuts = sorted({-(2**63), *(found or ())})
    heavy = [(found or []).count(c) for c in cuts]  # a cut that several quantiles share
    between = needed((rows - nulls) / CUTS**2)
    points = [needed((rows - nulls) * n / CUTS**2) if n > 1 else 1 for n in heavy]
    most = max(between, *points)
    groups = [cuts[i : i + CUTS] for i in range(0, len(cuts), CUTS)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    outer = below(longs([g[0] for g in groups]))
    place = (outer - 1) * CUTS + below(F.element_at(F.array(*[longs(g) for g in groups]), outer))  # from 1
    low, high = (F.element_at(longs(x), place) for x in (cuts, [*cuts[1:], 2**63 - 1]))
    width = high.cast("double") - low.cast("double")
    inside = F.floor((F.col("doc_id").cast("double") - low.cast("double")) / F.greatest(width, F.lit(1.0)) * between)
    own = most + F.least(F.greatest(inside, F.lit(0)), F.lit(between - 1))
    if max(heavy) > 1:
        parts = F.element_at(longs(points), place)
        own = F.when((F.col("doc_id") == low) & (parts > 1), parts - 1 - cut_by_h(parts)).otherwise(own)
    return F.when(F.col("doc_id").isNull(), none).otherwise(place.cast("long") * (2 * most) + own).cast("long"), 2 * most


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, rid, doc_id, text, next_text, last): each row and the text of
    the next in descending doc_id, after the last the first; last marks a bucket's last
    row, whose next one lies in another.

    Repeated ids are ordered by a hash of the text, null ids come last. Rows are dealt
    into ranges of doc_id of about ROWS_A_BUCKET rows, so no window spans the whole
    table; the first row of each range is joined to the range before it. Texts are shuffled
    once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 33))
    bucket, span = ranges(docs)
    placed = docs.withColumn("bucket", bucket)
    w = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "h", "text")
    rows = placed.select("bucket", "doc_id", "h", "text").withColumns({"rid": F.row_number().over(w), "next_text": F.lead("text").over(w), "first": F.lag("bucket").over(w).isNull()})
    known = placed.select("bucket").distinct().withColumn("part", F.floor(F.col("bucket") / span))
    ends = known.groupBy("part").agg(F.min("bucket").alias("bottom"))  # a row for two quantiles, and one for null
    ends = ends.select("part", F.coalesce(F.lag("bottom").over(W.orderBy(F.desc("part"))), F.min("bottom").over(W.partitionBy())).alias("above"))
    within = W.partitionBy("part").orderBy(F.desc("bucket"))
    before = known.join(ends, "part").select("bucket", F.coalesce(F.lag("bucket").over(within), F.col("above")).alias("to"))
    heads = rows.where("first").select("bucket", "text").join(before, "bucket").select(F.col("to").alias("bucket"), F.col("text").alias("head"))
    last = F.col("next_text").isNull()
    return rows.join(heads, "bucket").select("bucket", "rid", "doc_id", "text", F.when(last, F.col("head")).otherwise(F.col("next_text")).alias("next_text"), last.alias("last"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of another text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty texts, an empty table gives no rows, other columns are
    not looked at, whatever their names. Repeated rows are rows of their own. One shuffle
    carries the texts; all that follows is partitioned by the same ranges.
    """
    rows = with_next(docs)
    changed = edited(F.col("text"), F.col("next_text"))
    given = lambda kind, text, n_chars=F.lit(0), sha=F.lit(""): F.struct(F.lit(kind).alias("kind"), n_chars.alias("n_chars"), sha.alias("sha"), text.alias("text"))
    own = [given(0, F.col("text"), F.char_length("text")), given(1, changed, sha=F.sha2(changed, 256))]
    every = F.when(F.col("last"), F.array(*own, given(2, F.col("next_text")))).otherwise(F.array(*own))
    texts = rows.select("bucket", "rid", "doc_id", F.explode(every).alias("t")).select("bucket", "rid", "doc_id", "t.kind", "t.n_chars", "t.sha", "t.text")
    prints = fingerprint(texts, ["bucket", "rid", "doc_id", "kind", "n_chars", "sha"])
    prints = prints.withColumn("f", F.struct("exact", "n", "lanes")).select("bucket", "rid", "doc_id", "kind", "n_chars", "sha", as_hex(F.col("f")).alias("hex"), signed(F.col("f")).alias("signs"))
    prints = prints.withColumn("norm", F.aggregate("signs", F.lit(0.0), lambda s, x: s + x * x))
    w = W.partitionBy("bucket").orderBy("rid", "kind")
    own = F.struct("sha", "hex", "signs", "norm")
    seen = prints.select("doc_id", "kind", "n_chars", "hex", "signs", "norm", F.lead(own, 1).over(w).alias("e"), F.lead(own, 2).over(w).alias("x")).where("kind = 0")
    return seen.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("e.sha").alias("edited_sha256"),
        F.col("hex").alias("fingerprint"),
        F.col("e.hex").alias("edited_fingerprint"),
        F.when(F.col("hex") == F.col("e.hex"), 1.0).otherwise(likeness(F.col("signs"), F.col("e.signs"), F.col("norm"), F.col("e.norm"))).alias("near_edited"),
        F.when(F.col("hex") == F.col("x.hex"), 1.0).otherwise(likeness(F.col("signs"), F.col("x.signs"), F.col("norm"), F.col("x.norm"))).alias("near_next"),
    )
