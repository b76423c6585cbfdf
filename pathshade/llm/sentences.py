"""Substring deduplication by sliding spans of sentences.

Sentences of more than WINDOW words are cut at word boundaries that their own
words choose: of every WINDOW consecutive words without a sentence's first one, that
with the least hash begins a piece (the first of equals). A piece thus has at most
WINDOW words, and where two texts share a passage their cuts agree from the first
such window on, whatever unpunctuated text is glued to either side.

A span is the shortest run of at least SENTENCES consecutive pieces that
holds at least WORDS words. Every piece begins a span, as far as the text
reaches; all spans of the corpus are hashed (128 bits) and joined, and a piece
goes if any occurrence of a span other than its first covers it. A shared passage
holds a whole span if it has 1 + (WINDOW - 1) + WORDS + WINDOW = 50 words or more.

Occurrences are ordered by doc_id, a hash of the text, then position. Spans are shuffled once and not
written. Before that, each stretch of HELD spans of a partition keeps only the first occurrence of
each: what comes later there cannot be the first of all, and travels under a key of its
own. So a span that a third of all documents hold sends one row a stretch to the task
that ranks it.
"""

from __future__ import annotations

import re
from itertools import chain, islice
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from pathshade.llm.ship import identity, unused
from pathshade.session import written

SENTENCES, WORDS = 2, 20
WINDOW = 15
#: Distinct spans that a worker holds at a time, about 30 MB.
HELD = 100_000
#: A sentence ends after ., ! or ? and white space, or at a line break, which it keeps.
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s|$)[^\n.!?]*)*(?:[.!?]+(?=\s|$)[^\S\n]*\n*|\n+|$)")
TOKEN = re.compile(r"\w+")
GAPS = re.compile(r"(\w+)")


def whole(text: str) -> list[str]:
    """Sentences that join to the text again."""
    return [x for x in SENTENCE.findall(text) if x]


def cut(sentence: str) -> list[str]:
    """Pieces that join to the sentence again."""
    if len(sentence) <= 2 * WINDOW:  # as many words have at least as many gaps, less one
        return [sentence]
    parts = GAPS.split(sentence)  # gaps at even places, words at odd ones
    words = parts[1::2]
    if len(words) <= WINDOW:
        return [sentence]
    keys = [crc32(w.lower().encode()) for w in words]
    out, at, least = [], 0, 0
    for last in range(WINDOW, len(keys)):
        if least <= last - WINDOW:
            window = keys[last - WINDOW + 1 : last + 1]
            least = last - WINDOW + 1 + window.index(min(window))
        elif keys[last] < keys[least]:
            least = last
        else:
            continue
        out.append("".join(parts[at : 2 * least + 1]))
        at = 2 * least + 1
    out.append("".join(parts[at:]))
    return out


def split(text: str) -> list[str]:
    """Pieces that join to the text again."""
    return [p for s in whole(text) for p in cut(s)]


def spans(pieces: list[str], sentences: int, words: int):
    """(first, length, digest) of the span that begins at each piece. Digests
    are of the lower-case words alone; pieces without words are passed over."""
    bare = [(i, TOKEN.findall(p.lower())) for i, p in enumerate(pieces)]
    bare = [(i, w) for i, w in bare if w]
    counts = [len(w) for _, w in bare]
    flat = [" ".join(w) for _, w in bare]
    end = held = 0
    for k, (i, _) in enumerate(bare):
        if k:
            held -= counts[k - 1]
        while end < len(bare) and (end - k < sentences or held < words):
            held += counts[end]
            end += 1
        if end - k < sentences or held < words:
            return
        yield i, bare[end - 1][0] - i + 1, xxhash.xxh3_128_digest("\n".join(flat[k:end]).encode())


def all_spans(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """span, doc_id, own, at, n, later: one row per occurrence, but for those equal in
    all. later marks occurrences that follow another of their stretch; their span is replaced by
    a key of their own, of another length."""
    schema = pa.schema([("span", pa.binary()), ("doc_id", pa.int64()), ("own", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("later", pa.bool_())])

    def run(batches):
        held: dict[bytes, tuple] = {}
        rows: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def later(place, n):
            key = b"%d %d %d" % (place[1], place[2], place[3])
            return (b"-" + xxhash.xxh3_128_digest(key), None if place[0] else place[1], place[2], place[3], n, True)

        def first(held):
            items = iter(held.items())
            while some := [(span, None if at[0] else at[1], at[2], at[3], n, False) for span, (at, n) in islice(items, 20_000)]:
                yield batch_of(some)

        for batch in batches:
            for from_ in range(0, batch.num_rows, 128):
                part = batch.slice(from_, 128)
                for doc, own, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for i, n, digest in spans(split(text or ""), sentences, words):
                        place = (doc is None, doc or 0, own, i)
                        known = held.get(digest)
                        if known is None:
                            held[digest] = (place, n)
                        elif place > known[0]:
                            rows.append(later(place, n))
                        elif place < known[0]:
                            rows.append(later(*known))
                            held[digest] = (place, n)
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
                if len(held) >= HELD:
                    yield from first(held)
                    held = {}
        if rows:
            yield batch_of(rows)
        yield from first(held)

    return docs.select(F.col("doc_id").cast("long"), identity().alias("own"), "text").mapInArrow(run, "span binary, doc_id long, own long, at int, n int, later boolean")


def repeated_sentences(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, own, spans (array of first piece and length) of the documents
    with spans to remove, one row each. Null ids order last, texts that share an id
    by their hash. Rows equal in doc_id and text are one document here, of which equal
    positions are one occurrence."""
    order = W.partitionBy("span").orderBy(F.asc_nulls_last("doc_id"), "own", "at")
    gone = all_spans(docs, sentences, words).withColumn("place", F.rank().over(order)).where("later or place > 1")
    return gone.groupBy("doc_id", "own").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def removed_mask(n: int, spans_) -> list[bool]:
    edge = [0] * (n + 1)
    for at, length in spans_:
        if at < n:
            edge[at] += 1
            edge[min(n, at + length)] -= 1
    out, depth = [], 0
    for i in range(n):
        depth += edge[i]
        out.append(depth > 0)
    return out


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, counts: bool = False) -> DataFrame:
    """``docs`` without the pieces that repeat earlier spans; all rows and
    columns stay, a text of which nothing is left is empty. n_chars, if present,
    follows the text. counts: also n_sentences and n_removed (sentences that lost
    a piece or all); columns of ``docs`` by these names give way to them. An empty table
    gives no rows.

    Null and empty texts have no sentences and stay as they are. Texts shorter
    than a span are never touched. A row is known by doc_id and text: different texts
    under one doc_id, or without one, lose only their own repeats. Rows that repeat an
    id and its text keep the same sentences; of equal texts without an id, which name
    no document, all but one lose every span.
    """
    # written, so that adaptive execution may split a document that many rows repeat
    found = written(repeated_sentences(docs, sentences, words), "spans-gone")
    if counts:
        docs = docs.drop("n_sentences", "n_removed")
    id_, gone_, own_, key_, copy_ = unused(docs, "_id", "_spans", "_own", "_key", "_copy")
    found = found.select(F.col("doc_id").alias(id_), F.col("own").alias(key_), F.col("spans").alias(gone_))
    others = [F.col(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text") and isinstance(f.dataType, T.AtomicType)]
    equal = W.partitionBy(own_).orderBy("doc_id", *others)
    keyed = docs.withColumn(own_, identity())
    keyed = keyed.withColumn(copy_, F.col("doc_id").isNull() & (F.row_number().over(equal) > 1))
    same = (F.col(own_) == F.col(key_)) & F.coalesce(F.col("doc_id") == F.col(id_), F.col("doc_id").isNull() & F.col(id_).isNull())
    joined = keyed.join(found, same, "left").select(*docs.columns, copy_, gone_)
    out = list(docs.schema.fields)
    names = [f.name for f in out]
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    more = [T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType())] if counts else []

    def run(batches):
        for batch in batches:
            for from_ in range(0, batch.num_rows, 128):
                part = batch.slice(from_, 128)
                columns = list(part.columns)
                marks, copies = columns.pop().to_pylist(), columns.pop().to_pylist()
                texts, total, removed, changed = [], [], [], []
                for text, gone, copy in zip(columns[at_text].to_pylist(), marks, copies, strict=True):
                    gone = [(g["at"], g["n"]) for g in gone or ()]
                    if copy:
                        gone = [(at, n) for at, n, _ in spans(split(text or ""), sentences, words)]
                    changed.append(bool(gone))
                    if not gone and not counts:
                        texts.append(text)
                        continue
                    full = whole(text or "")
                    total.append(len(full))
                    if not gone:
                        texts.append(text)
                        removed.append(0)
                        continue
                    cuts = [cut(s) for s in full]
                    mask = removed_mask(sum(map(len, cuts)), gone)
                    texts.append("".join(p for p, m in zip(chain.from_iterable(cuts), mask, strict=True) if not m))
                    marked = iter(mask)
                    removed.append(sum(any([next(marked) for _ in c]) for c in cuts))
                if at_chars >= 0:
                    old = columns[at_chars].to_pylist()
                    columns[at_chars] = pa.array([len(t or "") if g else o for t, g, o in zip(texts, changed, old, strict=True)], columns[at_chars].type)
                columns[at_text] = pa.array(texts, columns[at_text].type)
                extra = [pa.array(total, pa.int32()), pa.array(removed, pa.int32())] if counts else []
                yield pa.RecordBatch.from_arrays(columns + extra, names=names + [f.name for f in more])

    return joined.mapInArrow(run, T.StructType(out + more))
