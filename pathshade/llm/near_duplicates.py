"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents with equal sets of word shingles form a class; classes are joined, not
documents. MinHash bands propose candidates. A pair's MinHash values are compared
a few at a time, and the pair is dropped as soon as the posterior probability
(uniform prior, Beta posterior) that its similarity reaches the threshold falls
below the tolerance; what is left is verified on the shingle sets.

Pairs never become rows. Classes that share buckets are gathered into blocks of
bounded size; blocks that share a bucket meet in one task, which finds all
candidates between the two, verifies them and returns one row per class: its
number of links and a spanning forest of them. A large group of near copies is
thus many blocks that meet pairwise, in as many tasks.

With 25 bands of 4 values a pair at the threshold of 0.8 is missed with
probability 2e-6, a tolerance of 1e-9 adds to that about as much.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from pathshade.llm.components import components
from pathshade.llm.ship import identity, unused
from pathshade.session import written

SHINGLE = 5
#: Similarity of 0.8 as a ratio of integers: 5 * common >= 4 * union.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 20, 1e-9
BLOCK = 256
TOKEN = re.compile(r"\w+")


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, and their MinHash values."""

    def __init__(self):
        self.place = _odd(SHINGLE, 1)
        self.a, self.b = _odd(HASHES, 2), _odd(HASHES, 3)
        self.words: dict[str, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """A text of fewer words than a shingle is one shingle; one without
        words has none."""
        words = TOKEN.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > 100_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - SHINGLE + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(words))):
            total += h[j : j + n] * self.place[j]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)

    def minhash(self, s: np.ndarray) -> np.ndarray:
        out = np.full(HASHES, 2**64 - 1, np.uint64)
        for at in range(0, len(s), 2048):
            v = s[at : at + 2048, None] * self.a
            v += self.b
            np.minimum(out, v.min(0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = (key ^ parts[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def least_matches() -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair): after m matches of k
    the posterior of the similarity is Beta(m + 1, k - m + 1)."""
    t = NUMERATOR / DENOMINATOR
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(k + 1):
            total += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if total >= TOLERANCE:
                out.append((k, m))
                break
    return out


def links_between(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool):
    """Index pairs (i of left, j of right) of verified links."""
    a, b = sig[left], sig[right]
    candidate = np.zeros((len(left), len(right)), bool)
    ka, kb = (np.stack([band_keys(s) for s in x]) for x in (a, b))
    for band in range(BANDS):
        candidate |= ka[:, band, None] == kb[None, :, band]
    if same:
        candidate &= np.triu(np.ones_like(candidate), 1)
    size = np.array([len(s) for s in sets], np.int64)
    i, j = np.nonzero(candidate)
    ni, nj = size[left[i]], size[right[j]]
    fits = np.minimum(ni, nj) * DENOMINATOR >= np.maximum(ni, nj) * NUMERATOR
    i, j = i[fits], j[fits]
    matches, done = np.zeros(len(i), np.int64), 0
    for k, least in least_matches():
        matches += (a[i, done:k] == b[j, done:k]).sum(1)
        kept = matches >= least
        i, j, matches, done = i[kept], j[kept], matches[kept], k
    if not len(i):
        return i, j
    used = np.unique(np.concatenate([left[i], right[j]]))
    flat, owner = np.concatenate([sets[u] for u in used]), np.repeat(np.arange(len(used)), size[used])
    _, number = np.unique(flat, return_inverse=True)
    width = int(number.max()) + 1
    at = {u: n for n, u in enumerate(used)}
    ui, uj = (np.array([at[x] for x in side[k]]) for side, k in ((left, i), (right, j)))
    common = np.zeros(len(i), np.int64)
    if len(i) > 4 * len(used) and len(used) * width <= 40_000_000:
        for start in range(0, width, 8192):  # shingles in columns, a slice at a time
            inside = (number >= start) & (number < start + 8192)
            m = np.zeros((len(used), min(8192, width - start)), np.float32)
            m[owner[inside], number[inside] - start] = 1
            common += (m @ m.T)[ui, uj].astype(np.int64)
    else:
        for n, (x, y) in enumerate(zip(used[ui], used[uj], strict=True)):
            s, t = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
            spot = np.minimum(np.searchsorted(t, s), len(t) - 1)
            common[n] = (t[spot] == s).sum()
    union = size[left[i]] + size[right[j]] - common
    linked = common * DENOMINATOR >= union * NUMERATOR
    return i[linked], j[linked]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, own, digest (of the shingle set; of a text without words, of the
    text), n, signature, bands for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        make = Shingler()
        for batch in batches:
            for from_ in range(0, batch.num_rows, 256):
                part = batch.slice(from_, 256)
                texts = part.column(2).to_pylist()
                sets = [make.shingles(t) for t in texts]
                sigs = [make.minhash(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([digest_of(s, t) for s, t in zip(sets, texts, strict=True)], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sigs], pa.binary()),
                        pa.array([band_keys(s).tolist() for s in sigs], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity().alias("own"), "text")
    return rows.mapInArrow(run, "doc_id long, own long, digest binary, n long, signature binary, bands array<long>")


def digest_of(s: np.ndarray, text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"-" + xxhash.xxh3_128_digest((text or "").encode())


def _payload(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, block, signature, shingles of the classes to compare, from the text of the
    class's first document. The join brings rows that repeat it together, of which
    neighbours are passed on once."""
    rows = docs.select(identity().alias("own"), "text").join(classes, "own").select("text", "digest", "cid", "block", "signature")
    schema = pa.schema([("cid", pa.int64()), ("block", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        make, last = Shingler(), None
        for batch in batches:
            for from_ in range(0, batch.num_rows, 256):
                part = batch.slice(from_, 256)
                cids, fresh = part.column(2).to_pylist(), []
                for c in cids:
                    fresh.append(c != last)
                    last = c
                part = part.filter(pa.array(fresh, pa.bool_()))
                texts = part.column(0).to_pylist()
                sets = [make.shingles(t) for t in texts]
                own = pa.array([digest_of(s, t) == d for s, t, d in zip(sets, texts, part.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema).filter(own)

    return rows.mapInArrow(run, "cid long, block long, signature binary, shingles binary")


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the one or two blocks of a task."""
    pdf = pdf.drop_duplicates("cid")
    cid = pdf.cid.to_numpy()
    sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf.signature])
    sets = [np.frombuffer(s, np.uint64) for s in pdf.shingles]
    blocks = np.unique(pdf.block)
    left = np.flatnonzero(pdf.block.to_numpy() == blocks[0])
    right = np.flatnonzero(pdf.block.to_numpy() == blocks[-1])
    if len(blocks) == 1 and pdf.cross.iloc[0]:  # the other block is empty
        left = right[:0]
    links = np.zeros(len(cid), np.int64)
    parent = list(range(len(cid)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(left) and len(right):
        i, j = links_between(sig, sets, left, right, len(blocks) == 1)
        np.add.at(links, left[i], 1)
        np.add.at(links, right[j], 1)
        for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    kept = np.flatnonzero(links)
    return pd.DataFrame({"cid": cid[kept], "links": links[kept], "root": cid[[root(int(x)) for x in kept]] if len(kept) else cid[:0]})


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, ...) of each row, and of each class digest, class_id, own (its first
    document, in the order of doc_id, null last, and text), n_links, group_id and
    group_own (the group's first document)."""
    seen = written(signatures(docs), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own")
    classes = seen.groupBy("digest").agg(F.min(first).alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = classes.where("n > 0").select("cid", F.explode("bands").alias("key"))
    # small sides of joins on keys that a large group shares are written, so that adaptive
    # execution may split the other side
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "shared")
    members = written(keys.join(shared, "key"), "members")
    labels = members.select("cid", F.col("cid").alias("label")).distinct()
    for _ in range(2):  # enough to gather most near copies; what is left apart still meets
        tagged = members.join(labels, "cid")
        least = written(tagged.groupBy("key").agg(F.min("label").alias("label")), "near-least")
        labels = written(members.join(least, "key").groupBy("cid").agg(F.min("label").alias("label")), "near-labels")
    sizes = written(labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "near-sizes")
    home = written(labels.join(sizes, "label").select("cid", F.xxhash64("label", F.pmod(F.xxhash64("cid"), F.col("blocks"))).alias("block")), "homes")

    at = members.join(home, "cid").select("key", "block").distinct()
    pairs = at.join(at.withColumnRenamed("block", "other"), "key").where("block <= other").select("block", "other").distinct()
    pairs = pairs.withColumn("pair", F.struct("block", "other")).select(F.explode(F.array_distinct(F.array("block", "other"))).alias("block"), "pair", (F.col("block") != F.col("other")).alias("cross"))
    payload = _payload(docs, home.join(classes.select("cid", F.col("rep.own").alias("own"), "digest", "signature"), "cid"))
    met = pairs.join(payload, "block").select(F.col("pair.block").alias("p"), F.col("pair.other").alias("q"), "block", "cross", "cid", "signature", "shingles")
    found = written(met.groupBy("p", "q").applyInPandas(_meet, "cid long, links long, root long"), "links")

    links = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "digest", "rep").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    named = written(named, "components")
    least = written(named.groupBy("component").agg(F.min("rep").alias("head")), "heads")
    named = named.join(least, "component").select(
        "digest",
        F.col("rep.doc_id").alias("class_id"),
        F.col("rep.own").alias("own"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("head.doc_id").alias("group_id"),
        F.col("head.own").alias("group_own"),
    )
    return seen, written(named, "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, group_id for every row of ``docs``.

    class_id is the smallest doc_id with the same set of shingles; n_links is the
    number of other classes at a similarity of 0.8 or more; group_id is the
    smallest doc_id of all classes that such links connect. Texts without words have no
    shingles and no links: equal ones form a class, null and empty texts the same one.
    Repeated rows are in one class, texts of any length are taken whole. Rows with a null id,
    and different texts under one id, are documents like all others and are linked; a
    class or group in which no document has an id has a null class_id or group_id.
    Empty tables give no rows; other columns are not looked at, whatever their names.
    """
    seen, named = classes_of(docs)
    return seen.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "n_links", "group_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that open their group: one document of each group
    of near copies stays, that with the smallest doc_id (null last, then by a hash of the text).
    A document is a doc_id and a text: different texts under one id, or none, are told
    apart, and of rows that repeat one, one stays. All columns stay, whatever their names."""
    _, named = classes_of(docs)
    heads = named.where("own = group_own")
    own, nth = unused(docs, "_own", "_nth")
    heads = heads.select(F.col("own").alias(own))
    others = [F.col(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text") and isinstance(f.dataType, T.AtomicType)]
    kept = docs.withColumn(own, identity()).join(heads, own, "left_semi")
    return kept.withColumn(nth, F.row_number().over(W.partitionBy(own).orderBy("doc_id", *others))).where(F.col(nth) == 1).select(docs.columns)
