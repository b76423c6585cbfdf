"""Toxicity by class-conditional Kneser-Ney models of words.

Each class (1 toxic, 0 ordinary) has an interpolated bigram model of four levels::

    P(w | v, class) = kept(c(v, w)) / c(v)    + lost(v)      * P(w | class)
    P(w | class)    = kept(N(., w)) / N(., .) + lost(class)  * P(w)
    P(w)            = shared continuation counts, discounted + lost(shared) * Q(w)
    Q(w)            = (documents of the corpus that hold w, plus 1), normalised

c counts the class's word pairs and N its distinct left contexts (continuation
counts); P(w) takes the distinct left contexts in both classes together and Kneser and
Ney's absolute discount n1 / (n1 + 2 n2). Rare expressions thus get their mass from
counts that both classes share, and so say little about the class. The discount of the
two class levels grows with the count, by MARGIN standard deviations (its square
root): what a class has beyond the shared counts is evidence only as far as it exceeds
chance. With the constant discount of the shared level at all levels, single pairs
of rare words outweigh insults (held-out figures are in the README).

A text is judged by its length-normalised log-likelihoods, toxic less ordinary: of the
whole text, and, because insults are few in a long text, the greatest of any
passage of 1 and of 4 words. A logistic regression turns the three differences into a
probability; it is fitted on training documents that models of other
training documents score (FOLDS of them).

The class counts and the regression are fitted on at most SAMPLE labelled documents,
chosen by a hash of doc_id, and keep every word and pair of these; Q covers all words of all
documents. All documents are scored, whole. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pathshade.llm.ship import lent, shipped
from pathshade.session import delete, scratch, written

SAMPLE, FOLDS = 16_000, 4
#: Standard deviations that the class levels' discounts take: of continuation counts, of pairs.
MARGIN = (1.0, 5.0)
PASSAGES = (1, 4)
WORDS = re.compile(r"\w+")
START = 0  # the history of a text's first word


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def word_hash(word: str) -> int:
    return (xxhash.xxh3_64_intdigest(word) >> 1) + 1


class Hashes(dict):
    """word -> hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = word_hash(word)
        return found


class Numbers(dict):
    """word -> its place among sorted hashes, or their number; remembered up to a bound."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.places = {h: i for i, h in enumerate(hashes.tolist())}

    def number(self, h: int) -> int:
        return self.places.get(h, len(self.places))

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = self.number(word_hash(word))
        return found


def discount(c, margin: float):
    return np.minimum(c, margin * np.sqrt(c))


class Model:
    """The two classes' models over the words of the sample. ``words`` are sorted
    hashes; ``documents`` their numbers of documents in the corpus, ``rest`` the sum
    of all other words' and the number of the corpus's words; ``contexts`` the
    distinct left contexts in class 0, class 1 and both; ``seen`` and ``lost`` the pairs
    that begin with a word and the discounts taken from them, by class; ``pairs``
    (v, w, count in class 0, in class 1) those that the discount leaves something of;
    ``docs`` the training documents of either class."""

    def __init__(self, words, documents, rest, contexts, seen, lost, pairs, docs):
        n = len(words)
        self.words, self.docs = words, docs
        mass = float(documents.sum()) + rest[0] + rest[1] + 1
        q = np.append((documents + 1) / mass, 1 / mass)  # the last is any one word that the sample lacks
        contexts = np.vstack([contexts, np.zeros((1, 3))])
        n1, n2 = (contexts[:, 2] == 1).sum(), (contexts[:, 2] == 2).sum()
        absolute = n1 / (n1 + 2 * n2) if n1 else 0.5  # without a single there is no estimate
        self.shared = self.level(contexts[:, 2], np.minimum(contexts[:, 2], absolute), q)
        self.single = np.stack([self.level(contexts[:, y], discount(contexts[:, y], MARGIN[0]), self.shared) for y in (0, 1)])
        seen, lost = (np.vstack([x, np.zeros((1, 2))]) for x in (seen, lost))
        self.back = np.where(seen > 0, lost / np.maximum(seen, 1), 1.0).T.copy()
        v, w = (np.searchsorted(words, pairs[:, k]) for k in (0, 1))
        key = v * (n + 1) + w
        order = np.argsort(key)
        self.keys, count = key[order], pairs[order, 2:].astype(np.float64)
        self.pair = ((count - discount(count, MARGIN[1])) / np.maximum(seen[v[order]], 1)).T.copy()
        self.index = None

    @staticmethod
    def level(count: np.ndarray, off: np.ndarray, below: np.ndarray) -> np.ndarray:
        total = count.sum()
        return (count - off + off.sum() * below) / total if total else below

    def ids(self, hashes: list[int]) -> np.ndarray:
        if self.index is None:  # once a worker
            self.index = {w: i for i, w in enumerate(self.words.tolist())}
        n, get = len(self.words), self.index.get
        return np.fromiter((get(h, n) for h in hashes), dtype=np.int64, count=len(hashes))

    def probabilities(self, hashes: list[int]) -> np.ndarray:
        """P(w | v, class) of each word of a text, by class."""
        ids = self.ids([START, *hashes])
        v, w = ids[:-1], ids[1:]
        out = self.back[:, v] * self.single[:, w]
        if len(self.keys):
            key = v * (len(self.words) + 1) + w
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            out[:, hit] += self.pair[:, at[hit]]
        return out

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """What scoring needs of a model: log ratios of the classes' probabilities, which
    without a kept pair are a sum of one for the history and one for the word."""

    def __init__(self, model: Model, weights: np.ndarray | None = None):
        self.words, self.docs, self.keys, self.weights, self.index = model.words, model.docs, model.keys, weights, None
        ratio = lambda x: np.log(x[1]) - np.log(x[0])
        self.history, self.word = ratio(model.back).astype(np.float32), ratio(model.single).astype(np.float32)
        v, w = np.divmod(model.keys, len(model.words) + 1)
        self.pair = ratio(model.back[:, v] * model.single[:, w] + model.pair).astype(np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        if self.index is None:  # once a worker
            self.index = Numbers(self.words)
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word after the one before, toxic less ordinary."""
        w = self.ids(words)
        v = np.concatenate(([self.index.number(START)], w[:-1]))
        out = self.history[v].astype(np.float64) + self.word[w]
        if len(self.keys):
            key = v * (len(self.words) + 1) + w
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            out[hit] = self.pair[at[hit]]
        return out

    def features(self, words: list[str]) -> list[float]:
        """Length-normalised log-likelihood, toxic less ordinary, of the text and of
        its most toxic passage of each length; 0 for a text without words."""
        if not words:
            return [0.0] * (1 + len(PASSAGES))
        sums = np.concatenate(([0.0], np.cumsum(self.ratios(words))))
        lengths = [min(n, len(words)) for n in PASSAGES]
        return [float(sums[-1] / len(words)), *(float((sums[n:] - sums[:-n]).max() / n) for n in lengths)]

    def score(self, words: list[str]) -> float:
        if not all(self.docs):
            return float(self.docs[1] > 0)
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ np.array(self.features(words)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (intercept first) by Newton steps on standardised features."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    pull = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    out = w[1:] / dev
    return np.concatenate(([w[0] - out @ mean], out))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the documents that hold each word, over all rows of ``docs``."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = Counter()
                for text in batch.column(0).slice(at, 512).to_pylist():
                    found.update(set(words_of(text)))
                yield pa.RecordBatch.from_pydict({"word": pa.array([known[w] for w in found], pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(v, w, n0 .. n<2 * FOLDS - 1>): occurrences of each word pair in the
    documents of slot y * FOLDS + fold, from (text, y, fold)."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = Counter()
                for text, y, fold in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                    hashes = [known[w] for w in words_of(text)]
                    slot = y * FOLDS + fold
                    found.update((v, w, slot) for v, w in zip([START, *hashes], hashes))
                v, w, slot = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_pydict({"v": pa.array(v, pa.int64()), "w": pa.array(w, pa.int64()), "slot": pa.array(slot, pa.int32()), "n": pa.array(list(found.values()), pa.int32())})

    rows = texts.select("text", "y", "fold").mapInArrow(run, "v long, w long, slot int, n int")
    return rows.groupBy("v", "w").agg(*[F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).cast("int").alias(f"n{k}") for k in range(2 * FOLDS)])


def matrix(df: DataFrame) -> np.ndarray:
    """A table of numbers, bounded by the sample, on the driver."""
    return np.column_stack([c.to_numpy() for c in df.toArrow().columns])


class Counts:
    """What the models of all folds need of the sample's pairs: the distinct
    left contexts of each word without each fold (and without none), its
    occurrences as a left context by slot, and the pairs of which the discount leaves something."""

    def __init__(self, pairs: DataFrame, corpus: DataFrame, rest: tuple[float, float]):
        n = lambda y: [F.col(f"n{y * FOLDS + f}") for f in range(FOLDS)]
        total = [sum(n(y)[1:], n(y)[0]) for y in (0, 1)]
        ends = []
        for without in [*range(FOLDS), None]:
            c = [t if without is None else t - n(y)[without] for y, t in enumerate(total)]
            ends += [F.count_if(x > 0).cast("int") for x in (*c, c[0] + c[1])]
        ends = matrix(pairs.groupBy("w").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]))
        begins = matrix(pairs.groupBy("v").agg(*[F.sum(f"n{k}").cast("int").alias(f"n{k}") for k in range(2 * FOLDS)]))
        self.left = matrix(pairs.where(F.greatest(*total) > MARGIN[1] ** 2)).astype(np.int64)
        self.words = np.union1d(ends[:, 0], begins[:, 0]).astype(np.int64)
        self.ends, self.begins = self.spread(ends), self.spread(begins)
        held = matrix(corpus.join(pairs.select(F.col("w").alias("word")).distinct(), "word", "left_semi"))
        self.documents = self.spread(held)[:, 0].astype(np.float64)
        self.rest = (rest[0] - self.documents.sum(), rest[1])

    def spread(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), rows.shape[1] - 1), np.int32)
        out[np.searchsorted(self.words, rows[:, 0])] = rows[:, 1:]
        return out

    def model(self, docs: tuple[int, int], without: int | None = None) -> Model:
        """The model of all folds but ``without``; docs: its documents by class."""
        folds = [f for f in range(FOLDS) if f != without]
        by_class = lambda c: np.column_stack([c[:, [y * FOLDS + f for f in folds]].sum(1) for y in (0, 1)])
        at = 3 * (FOLDS if without is None else without)
        pairs = np.column_stack([self.left[:, :2], by_class(self.left[:, 2:])])
        pairs = pairs[pairs[:, 2:].max(1, initial=0) > MARGIN[1] ** 2]
        seen = by_class(self.begins).astype(np.float64)
        lost = seen.copy()  # the discount takes all of a pair below MARGIN ** 2, and this of the others
        count = pairs[:, 2:].astype(np.float64)
        np.subtract.at(lost, np.searchsorted(self.words, pairs[:, 0]), count - discount(count, MARGIN[1]))
        return Model(self.words, self.documents, self.rest, self.ends[:, at : at + 3].astype(np.float64), seen, lost, pairs, docs)


def counted(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, np.ndarray, Counts | None]:
    """The training texts, their numbers by class and fold, and their counts (none
    without both classes)."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``sample`` rows of 12 bytes
    texts = written(texts.select("text", "y", F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    sizes = np.zeros((2, FOLDS), np.int64)
    for r in texts.groupBy("y", "fold").count().collect():
        sizes[r["y"], r["fold"]] = r["count"]
    if not sizes.sum(1).all():
        return texts, sizes, None
    pairs = written(pair_counts(texts), "toxicity-pairs")
    corpus = written(corpus_counts(docs), "toxicity-words")
    whole, kinds = corpus.agg(F.sum("n"), F.count(F.lit(1))).first()
    return texts, sizes, Counts(pairs, corpus, (float(whole or 0), float(kinds)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit on the labelled rows that are not held out; null labels and null ids
    take no part, of several labels of one id toxic wins, and every row of ``docs`` with a
    chosen id is a training document (a null text is an empty one). Without
    rows of both classes every score is 0, or 1 if all are toxic; empty tables are
    such a case. No other columns are looked at."""
    with scratch() as spent:
        model = fitted(docs, labels, sample)
    for path in spent:
        delete(docs.sparkSession, path)
    return model


def fitted(docs: DataFrame, labels: DataFrame, sample: int) -> Scorer:
    texts, sizes, counts = counted(docs, labels, sample)
    total = tuple(int(x) for x in sizes.sum(1))
    if counts is None:
        none = np.zeros(0, np.int64)
        return Model(none, np.zeros(0), (0.0, 0.0), np.zeros((0, 3)), np.zeros((0, 2)), np.zeros((0, 2)), np.zeros((0, 4), np.int64), total).scorer()
    features, marks = [], []
    for fold in range(FOLDS):
        docs_left = tuple(int(x) for x in np.delete(sizes, fold, 1).sum(1))
        if not sizes[:, fold].sum() or not all(docs_left):
            continue
        with lent(docs.sparkSession, counts.model(docs_left, fold).scorer()) as shared:

            def value(batches, shared=shared):
                m = shared()
                for batch in batches:
                    f = [m.features(words_of(x)) for x in batch.column(0).to_pylist()]
                    yield pa.RecordBatch.from_pydict({"y": batch.column(1), **{f"f{i}": pa.array([v[i] for v in f], pa.float64()) for i in range(1 + len(PASSAGES))}})

            rows = matrix(texts.where(F.col("fold") == fold).select("text", "y").mapInArrow(value, "y int, " + ", ".join(f"f{i} double" for i in range(1 + len(PASSAGES)))))
        marks.append(rows[:, 0])
        features.append(rows[:, 1:])
    weights = logistic(np.concatenate(features), np.concatenate(marks)) if features else np.zeros(2 + len(PASSAGES))
    return Scorer(counts.model(total), weights)


def scored(docs: DataFrame, model: Scorer, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``. Only the
    text is an input of the score; null texts are empty and score what a text without
    words does; a null doc_id counts as not held out. Repeated rows are scored alike, texts
    of any length whole; an empty table gives no rows and other columns are not looked at."""
    shared = shipped(docs.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([m.score(words_of(x)) for x in part.column(1).to_pylist()], pa.float64())], schema=schema)

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Scorer, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, in one pass; null and empty
    texts score what a text without words does, other columns pass through whatever their names."""
    shared = shipped(docs.sparkSession, model)
    at_text = docs.columns.index("text")

    def run(batches):
        m = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([m.score(words_of(x)) < least for x in part.column(at_text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
