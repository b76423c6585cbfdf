"""Each operator against brute force, on ties, nulls, empty tables and clashing names."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathshade.llm import fingerprints, mixing, near_duplicates, sentences, toxicity, warc
from pathshade.llm.chat_format import format_preferences
from pathshade.llm.components import components
from pathshade.llm.pieces import LongestMatchCounter, PieceModel, ViterbiEncoder, decode, encode, encode_digests, token_counts
from pathshade.llm.queries import PIECE_MODEL
from pathshade.llm.topk_search import exact_topk, quantised, usable

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, digest string, words string, spans string, score string"
VOCAB = [a + b for a in "kalomi" for b in ("ta", "ren", "sol", "u", "vik", "pe")]


def prose(rng, sentences_=8):
    return " ".join(" ".join(rng.choices(VOCAB, k=rng.randint(4, 14))).capitalize() + "." for _ in range(sentences_))


def rows_of(spark, texts):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x") for i, t, s in texts], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 12)) for _ in range(40)]
    passage = prose(rng, 9)
    texts = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for n in range(12):
        words = base[2].split()
        words[n] = "odd" + str(n)
        texts.append((100 + n, " ".join(words), "s1"))
    texts += [(200, base[0], "s0"), (201, base[0], None), (202, prose(rng, 3) + " " + passage + " " + prose(rng, 3), "s2"), (203, prose(rng, 2) + " " + passage, "s2")]
    texts += [(300, None, "s0"), (301, "", "s1"), (302, "one", "s1"), (303, " \n\t ", None), (None, base[5], "s0"), (7, base[7], "s3"), (304, prose(rng, 1500), "s2")]
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return rows_of(spark, corpus).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return rows_of(spark, [])


# 1


def test_warc_revisits(spark):
    big, other = "a\r\n\r\nWARC/1.1\r\n" + "é" * 60, "b" * 100
    pages = [(5, "http://x/5", big), (3, "http://x/3\r\nEvil: 1", big), (9, None, big), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (10, "u", other), (10, "u", other), (None, "u", other)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record_type string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.deduplicated_pages(df).collect())
    want = Counter()
    seen = set()
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        body = (h or "").encode()
        first = min((p[0] for p in pages if p[2] == h and p[0] is not None), default=None)
        repeat = len(body) >= 100 and h in seen
        seen.add(h)
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if repeat else "response", first if repeat else None)] += 1
    assert got == want


def test_warc_hot_digests_and_large_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1)
    monkeypatch.setattr(warc, "HOT", 2)
    pages = [(n, "u", "a" * 200) for n in range(20)] + [(30 + n, "u", "b" * 300) for n in range(4)] + [(50, "u", "c" * 40_000), (51, "u", "c" * 40_000), (60, "u", "d" * 120), (61, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.deduplicated_pages(df).collect()}
    assert got == {i: (len(h), {"a": 0, "b": 30, "c": 50}.get(h[:1]) if i not in (0, 30, 50) else None) for i, _, h in pages}


def test_warc_empty(spark):
    assert warc.deduplicated_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2


def brute_spans(texts):
    seen, out = set(), []
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0))
    for k in order:
        pieces = sentences.split(texts[k][1] or "")
        bare = [(n, re.findall(r"\w+", p.lower())) for n, p in enumerate(pieces)]
        bare = [b for b in bare if b[1]]
        gone = set()
        for a in range(len(bare)):
            for b in range(a + sentences.SENTENCES, len(bare) + 1):
                if sum(len(w) for _, w in bare[a:b]) >= sentences.WORDS:
                    key = tuple(tuple(w) for _, w in bare[a:b])
                    if key in seen:
                        gone |= set(range(bare[a][0], bare[b - 1][0] + 1))
                    seen.add(key)
                    break
        out.append((texts[k][0], "".join(p for n, p in enumerate(pieces) if n not in gone) if gone else texts[k][1]))
    return Counter(out)


@pytest.mark.parametrize("held", [sentences.HELD, 7])
def test_sentence_spans(spark, corpus, docs, empty, monkeypatch, held):
    monkeypatch.setattr(sentences, "HELD", held)
    assert sentences.without_repeats(empty).count() == sentences.without_repeats(empty, counts=True).count() == 0
    once = [t for n, t in enumerate(corpus) if t[0] not in {x[0] for x in corpus[:n]}]
    out = sentences.without_repeats(rows_of(spark, once))
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == brute_spans(once)
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_repeated_rows_keep_the_same_sentences(spark, docs):
    kept = [r.text for r in sentences.without_repeats(docs).where("doc_id = 7").collect()]
    assert len(kept) == 2 and kept[0] == kept[1] != ""


def test_sentences_join_to_the_text(corpus):
    for _, t, _ in corpus:
        assert "".join(sentences.split(t or "")) == (t or "")
    assert sentences.split("v1.2 is out!! Yes.\n\nNo") == ["v1.2 is out!! ", "Yes.\n\n", "No"]


ITEM_86 = (
    "Edon a inound anha, to whwh. Inheou tionhe that erouly onnd ines erhe of, onanblesh bleen a is reblent thst hation and, ly that with oningre it sh erer the with "
    "atedor was wh by and thenshnd stnttion thwh thatin thwheaed relynt thtiwh thnd thblest ofonwherer insh at ershes aterer ofstntst the es."
)


def test_a_passage_glued_to_other_words_is_found(spark):
    rng = random.Random(86)
    loose = lambda n: " ".join(rng.choices(VOCAB, k=n))
    one = " ".join(f"{a}{n}" for n, a in enumerate(rng.choices(VOCAB, k=50)))
    texts = [(1, f"{loose(19)} {ITEM_86} {loose(6)}.", "s"), (2, f"{loose(24)}. {loose(13)} {ITEM_86} {loose(4)}.", "s")]
    texts += [(n, f"{loose(rng.randint(0, 30))} {one} {loose(rng.randint(0, 30))}", "s") for n in range(3, 23)]
    left = {r.doc_id: r.text for r in sentences.without_repeats(rows_of(spark, texts)).collect()}
    assert left[1] == texts[0][1] and left[3] == texts[2][1]
    assert len(set(ITEM_86.split()[-47:]) & set(left[2].split())) <= 15
    assert all(len(set(one.split()) & set(left[n].split())) <= 30 for n in range(4, 23))


def test_counts_are_of_sentences(spark):
    long = " ".join(f"w{n}" for n in range(60)) + ". "
    docs = rows_of(spark, [(1, "One two. " + long, "s"), (2, "Three. " + long + "Four five.", "s")]).select("doc_id", "text", F.lit("x").alias("n_removed"))
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in sentences.without_repeats(docs, counts=True).collect()}
    assert got == {1: (2, 0), 2: (3, 1)}


def test_rows_of_one_id_or_none_lose_only_their_own_repeats(spark):
    rng = random.Random(8)
    p = [prose(rng, 8) for _ in range(6)]
    # both texts of id 5 and of null begin with sentences that stay; p[0] is repeated in one each
    texts = [(1, p[0], "s"), (5, p[0], "s"), (5, p[1], "s"), (None, p[0], "s"), (None, p[2], "s"), (None, p[3], "s"), (None, p[3], "s"), (None, p[3], "t"), (None, None, "s"), (None, None, "s")]
    rows = sentences.without_repeats(rows_of(spark, texts)).collect()
    got = Counter((r.doc_id, r.text) for r in rows)
    assert got[1, p[0]] == got[5, p[1]] == got[None, p[2]] == got[None, p[3]] == 1
    assert len(rows) == len(texts) and got[None, None] == 2
    assert got[5, p[0]] == got[None, p[0]] == 0
    assert sum(p[3][:40] in (r.text or "") for r in rows) == 1
    assert all(r.n_chars == len(r.text or "") for r in rows)


# 3 and 10


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(PIECE_MODEL)


STRINGS = ["", " ", "a", "  two  spaces ", "The retitioning of\nlines\tand tabs", "naïve 日本語 🙂 x", "ab" * 300, "\x00\x7f", "<0x0A> <s>"]


def test_viterbi_is_the_best_segmentation(model):
    v = ViterbiEncoder(model)
    score = {p: (s, i) for p, i, s in model.matched()}
    longest, low = max(map(len, score)), min(s for s, _ in score.values())
    for text in STRINGS:
        t = ("▁" + text.replace(" ", "▁")) if text else ""
        best = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            for b in range(max(0, e - longest), e):
                s = score.get(t[b:e], (low - 10 if e - b == 1 else -math.inf,))[0]
                best[e] = max(best[e], best[b] + s)
        ids, total = v.encode(text)
        assert total == pytest.approx(best[-1]) and v.decode(ids) == text


def test_ids_decode_as_the_library_decodes_them(model):
    spm = pytest.importorskip("sentencepiece")
    sp = spm.SentencePieceProcessor(model_file=PIECE_MODEL)
    v = ViterbiEncoder(model)
    for text in STRINGS:
        assert sp.decode(v.encode(text)[0]) == text


def test_encoded_table_against_all_segmentations(spark, model):
    rng = random.Random(6)
    texts = [prose(rng, 2) + rng.choice(["", " ñandú 日本", "\n\tx  y", "🙂"]) for _ in range(30)] + ["ab" * 4000, "", None]
    score = {p: s for p, _, s in model.matched()}
    longest, low = max(map(len, score)), min(score.values())
    got = {r.doc_id: r for r in encode(rows_of(spark, [(n, t, "s") for n, t in enumerate(texts)]), PIECE_MODEL).collect()}
    for n, text in enumerate(texts):
        t = ("▁" + text.replace(" ", "▁")) if text else ""
        best = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            best[e] = max(best[b] + score.get(t[b:e], low - 10 if e - b == 1 else -math.inf) for b in range(max(0, e - longest), e))
        assert got[n].score == pytest.approx(best[-1])
        spelt = b"".join(bytes([int(p[3:5], 16)]) if k == 6 else p.encode() for p, k in ((model.pieces[i], model.kinds[i]) for i in got[n].ids))
        assert spelt.decode() == t
        # single characters without a piece cost the penalty, their bytes nothing more
        own = sum(score[model.pieces[i]] for i in got[n].ids if model.kinds[i] != 6)
        assert own + (low - 10) * sum(c not in score for c in t) == pytest.approx(got[n].score)


def test_encode_and_decode_tables(spark, corpus, docs, empty):
    tokens = encode(docs, PIECE_MODEL)
    back = Counter((r.doc_id, r.text) for r in decode(tokens, PIECE_MODEL).collect())
    assert back == Counter((i, t or "") for i, t, _ in corpus)
    assert all(r.round_trip for r in encode_digests(docs, PIECE_MODEL).collect())
    assert encode(empty, PIECE_MODEL).count() == 0


def test_longest_match_counts(model):
    tk = pytest.importorskip("tokenizers")
    for first, inner in ((["a", "ab", "abc", "x"], ["b", "c", "bc", "cd", "d", "e"]), ([], ["a"]), (["a"], [])):
        vocab = {w: i for i, w in enumerate(dict.fromkeys([*first, *("##" + w for w in inner), "[UNK]"]))}
        lib = tk.Tokenizer(tk.models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
        own = LongestMatchCounter(first, inner)
        rng = random.Random(1)
        for _ in range(400):
            w = "".join(rng.choices("abcdex", k=rng.randint(1, 9)))
            assert (own.count(w) or 1) == len(lib.encode(w).ids), w


def naive_count(pieces, longest, word):
    """Longest piece first, at each place; a character without one is its bytes."""
    text, at, n = "▁" + word, 0, 0
    while at < len(text):
        size = next((k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in pieces and (at == 0 or text[at] != "▁")), 0)
        n += 1 if size else len(text[at].encode())
        at += size or 1
    return n


def test_token_counts_of_the_real_model(model):
    import pyarrow.parquet as pq

    pieces = {p for p, _, _ in model.matched()}
    longest, own = max(map(len, pieces)), LongestMatchCounter.of(model)
    words = {"ç", "ñta", "日本語", "🙂x", "a🙂", "\x00", "▁x▁", "x" * 5000}
    if os.path.exists("/root/testdata/sf0.01/documents.parquet"):
        for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
            words.update(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert all(own.count(w) == naive_count(pieces, longest, w) for w in words)
    for trial in range(300):  # random small vocabularies with bytes
        rng = random.Random(trial)
        some = lambda: {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        first, inner = some() | ({""} if trial % 2 else set()), some()
        small = LongestMatchCounter(sorted(first), sorted(inner), True)
        for _ in range(20):
            w = "".join(rng.choices("abcé", k=rng.randint(1, 9)))
            assert small.count(w) == naive_count({"▁" + x for x in first} | inner, 5, w), (first, inner, w)


def test_models_that_would_give_other_ids_are_refused(tmp_path):
    field = lambda number, value: bytes([number << 3 | 2, len(value)]) + value
    piece = field(1, field(1, b"a") + bytes([3 << 3, 4]))
    for name, data in (("mapped", field(3, field(2, b"map"))), ("forced", piece)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            PieceModel.load(str(tmp_path / name))


def test_token_counts_table(spark, corpus, docs, empty, model):
    own = LongestMatchCounter.of(model)
    want = Counter()
    for i, t, _ in corpus:
        n = [own.count(w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")]
        want[(i, len(n), sum(x or 1 for x in n), n.count(0))] += 1
    assert Counter(tuple(r) for r in token_counts(docs, PIECE_MODEL).collect()) == want
    assert token_counts(empty, PIECE_MODEL).count() == 0


# 4


def words_in(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_mix(spark, rows, seed=20, buckets=1):
    """(doc_id, text, source) -> their targets, and a row (index, words) for each pass of each
    document, by plain loops; only the hashes that permute the documents come from Spark."""
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, doc_id long, text string, source string").withColumn("d", F.xxhash64("doc_id", "source", "text"))
    keys = {r.n: (r.b, r.h, r.d) for r in df.select("n", "d", F.pmod(F.xxhash64(F.lit(seed), "d"), F.lit(buckets)).alias("b"), F.xxhash64(F.lit(seed + 1), "d").alias("h")).collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words_in(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            target[s] = 2.0 * size[s]
            free.discard(s)
        left = 1.5 * sum(size.values()) - sum(target.values())
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    out = []
    for s in order:
        own = sorted((n for n, r in enumerate(rows) if r[2] == s), key=lambda n: (*keys[n], rows[n][0] is not None, rows[n][0] or 0))
        for again in range(2):
            at = again * size[s]
            for n in own:
                here = len(words_in(rows[n][1]))
                words = max(0, min(here, math.floor(target[s] + 0.5) - at))
                at += here
                if words:
                    out.append((n, words))
    return size, target, out


@pytest.mark.parametrize("options", [{"depth": 2, "units": 8, "buckets": 4}, {}])
def test_mix_sizes(spark, corpus, docs, empty, options):
    rows = mixing.mix_sizes(docs, **options).collect()
    size, target, passes = brute_mix(spark, corpus, buckets=options.get("buckets", 1))
    taken = Counter()
    for n, words in passes:
        taken[n] += words
    want = Counter((i, len(words_in(t)), size[s], round(target[s], 6), taken[n]) for n, (i, t, s) in enumerate(corpus))
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows) == want
    again = mixing.mix_sizes(docs.repartition(7), **options).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert mixing.mix_sizes(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_layout_grows_with_the_words():
    assert mixing.layout(0) == mixing.layout(1) == (0, 1)
    for words in (10**6, 10**9, 10**13):
        depth, tasks = mixing.layout(words)
        assert depth <= 12 and words / (tasks << depth) <= mixing.TASK_WORDS <= 4 * words / (tasks << depth)


def test_mixed_documents(spark, docs):
    rows = mixing.mix(docs, depth=2, units=8, buckets=4).where("words > 0").collect()
    out = mixing.mixed_documents(docs, depth=2, units=8, buckets=4)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and {r.shard for r in rows} == {0, 1, 2, 3}
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, count(r.text)) for r in got) == Counter((r.doc_id, r.words) for r in rows)


def test_split_tree_is_exact(spark):
    quotas = spark.createDataFrame([(0, 37), (1, 1), (2, 26), (3, 0)], "rank int, blocks long")
    runs = mixing.split_tree(quotas, 3, 1).collect()
    total = Counter()
    for r in runs:
        total[r["rank"]] += r.quota
    assert total == {0: 37, 1: 1, 2: 26}
    assert all(v == 8 for v in Counter({s: sum(r.quota for r in runs if r.shard == s) for s in range(8)}).values())


# 5


def test_exact_topk(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(300)]
    data += [(400 + i, data[50][1]) for i in range(8)] + [(500, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf"), 1.0]), (700, []), (750, [2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string")
    vectors = df.where(usable("embedding")).select("vec_id", quantised("embedding").alias("vector"))
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for q, x in ok:
        if q % 50 == 0:
            s = sorted((-int(sum(a * b for a, b in zip(x, y))), i) for i, y in ok if i != q)[:5]
            want |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s)}
    for blocks in ({}, {"query_block": 3, "candidate_block": 40}):
        got = {tuple(r) for r in exact_topk(vectors.where("vec_id % 50 = 0"), vectors, 5, **blocks).collect()}
        assert got == want
    none = vectors.where("vec_id < 0")
    assert exact_topk(none, none).count() == 0
    assert exact_topk(vectors.where("vec_id = 0"), vectors.where("vec_id in (0, 50)"), 5).count() == 1


def test_topk_of_repeated_and_missing_ids(spark):
    rows = [(0, [1, 2])] + [(9, [3, 3])] * 7 + [(None, [3, 3]), (4, [3, 3]), (0, [5, 5])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    for blocks in ({}, {"query_block": 1, "candidate_block": 2}):
        got = [(r["rank"], r.vec_id, r.score) for r in exact_topk(df.where("vec_id = 0 and vector[0] = 1"), df, 7, **blocks).orderBy("rank").collect()]
        assert got == [(1, 4, 9)] + [(n, 9, 9) for n in range(2, 8)]


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 5]), (2, [2**40, 4])], "vec_id long, vector array<long>")
    got = [(r.vec_id, r.score) for r in exact_topk(df.where("vec_id = 0"), df).orderBy("rank").collect()]
    assert [g[0] for g in got] == [1, 2]


# 6


def brute_likeness(a, b, rows):
    """Cosine of the signs that the sketch stands for, from one hash table of word pairs."""

    def signs(text):
        pairs = Counter()
        for line in text.split("\n"):
            words = re.split("[\x20\x09-\x0d]+", line)
            pairs.update(zip(words, [*words[1:], ""]))
        out = np.zeros(fingerprints.LANES)
        for p, n in pairs.items():
            out += n * rows[p]
        return out

    x, y = signs(a), signs(b)
    norm = float(x @ x) * float(y @ y)
    return 0.0 if not norm else min(1.0, max(0.0, float(x @ y) / math.sqrt(norm)))


def sign_rows(spark, texts):
    """The +1 and -1 of each word pair, lane by lane: bit b + 21 i of the pair's hash by seed."""
    pairs = set()
    for text in texts:
        for line in text.split("\n"):
            words = re.split("[\x20\x09-\x0d]+", line)
            pairs.update(zip(words, [*words[1:], ""]))
    df = spark.createDataFrame(sorted(pairs), "a string, b string").select("a", "b", *[F.xxhash64(F.lit(k), "a", "b").alias(f"h{k}") for k in range(fingerprints.SEEDS)])
    bits = [(k, b + 21 * i) for k in range(fingerprints.SEEDS) for b in range(21) for i in range(3)]
    return {(r.a, r.b): np.array([2 * (r[f"h{k}"] >> at & 1) - 1 for k, at in bits]) for r in df.collect()}


def in_order(spark, texts):
    """(doc_id, text) in descending order of doc_id, null last, then of a hash of the text."""
    unique = sorted({t for _, t in texts})
    h = {r.t: r.h for r in spark.createDataFrame([(t,) for t in unique], "t string").select("t", F.shiftrightunsigned(F.xxhash64("t"), 33).alias("h")).collect()}
    return sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1]))


def check_fingerprints(spark, texts, rows):
    order = in_order(spark, [(i, t or "") for i, t in texts])
    edited = [t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2] for k, (_, t) in enumerate(order)]
    signs = sign_rows(spark, [*(t for _, t in order), *edited])
    want = Counter()
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        near = [1.0 if t == x else brute_likeness(t, x, signs) for x in (edited[k], following)]
        want[(i, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), *(round(x, 6) + 0.0 for x in near))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 6) + 0.0, round(r.near_next, 6) + 0.0) for r in rows) == want


def test_fingerprints(spark, corpus, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 7)
    rows = fingerprints.fingerprint_edits(docs).collect()
    check_fingerprints(spark, [(i, t) for i, t, _ in corpus], rows)
    text = {}
    for i, t, _ in corpus:
        text.setdefault(i, t or "")
    prints = {}
    for r in rows:
        prints.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    assert fingerprints.fingerprint_edits(empty).count() == 0


@pytest.mark.parametrize("ids", [lambda n: 5, lambda n: None, lambda n: n * n * n, lambda n: [n, 2**63 - 1, -(2**63), None, 7][min(n // 20, 4)], lambda n: n % 3 or None])
def test_ranges_of_odd_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 3)
    monkeypatch.setattr(fingerprints, "CUTS", 2)
    texts = [(ids(n), f"text {n % 90} of some words\nand {n % 7}") for n in range(100)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    buckets = fingerprints.with_next(df).groupBy("bucket").count().collect()
    check_fingerprints(spark, texts, fingerprints.fingerprint_edits(df).collect())
    assert len(buckets) > 5 and max(b["count"] for b in buckets) < 60


def test_likeness_of_long_repetitive_texts(spark):
    texts = [(2, "spam ham " * 70_000), (1, "spam ham " * 70_001 + "x")]
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    check_fingerprints(spark, texts, rows.values())
    assert rows[2].near_edited > 0.99 and rows[2].near_next > 0.99


def test_fingerprints_have_all_their_bits(spark):
    row = fingerprints.fingerprint_edits(rows_of(spark, [(1, "a b c\nd", "s"), (2, "e f", "s")])).first()
    assert fingerprints.EXACT_LANES * fingerprints.EXACT_BITS >= 256
    assert len(row.fingerprint) == 11 * fingerprints.EXACT_LANES + 8 + 8 * 252


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([(0, "a b\nc d e\na b"), (1, "c d e\na b\na b"), (2, "a b"), (3, "c d e\na b")], "k long, text string")
    f = {r.k: r.f for r in fingerprints.fingerprint(df, ["k"]).select("k", F.struct("exact", "n", "lanes").alias("f")).collect()}
    assert f[0] == f[1] != f[3]
    table = spark.createDataFrame([(f[3], f[2], f[0])], ["a", "b", "c"])
    both = table.select(fingerprints.combined(F.col("a"), F.col("b")).alias("x"), fingerprints.combined(F.col("c"), F.col("b"), -1).alias("y")).first()
    assert both.x.lanes == f[0].lanes and both.x.exact == f[0].exact and both.y.lanes == f[3].lanes and both.y.n == f[3].n


# 7


def test_chat_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "ok"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "x"), (4, 0, "user", "same"), (5, 0, "user", "same"), (6, None, None, None), (7, 0, "user", "é"), (None, 0, "user", "gone")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    out = {r.pair_id: r for r in format_preferences(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 1).collect()}
    assert set(out) == {0, 1, 2, 3}
    p = out[0]
    assert p.prompt_turns == 1 and p.prompt == "<|user|>\nhi<|end|>\n"
    assert [p.chosen[s.start : s.stop] for s in p.chosen_mask] == ["yes<|end|>\n", "ok<|end|>\n"]
    assert [p.rejected[s.start : s.stop] for s in p.rejected_mask] == ["no<|end|>\n"]
    assert out[1].rejected_id is None and out[1].prompt == "" and out[1].rejected == ""
    assert (out[2].prompt_turns, out[2].chosen, out[2].rejected) == (1, "", "")
    assert out[3].chosen == "<||>\n<|end|>\n"
    assert format_preferences(df.where("conv_id < 0"), F.col("conv_id"), F.lit(False)).count() == 0


# 8


def near_classes(texts):
    """Members (indices into texts) of each class, and the other classes that each is linked to."""

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else (t or "")

    members = {}
    for k, (_, t, _) in enumerate(texts):
        members.setdefault(grams(t), []).append(k)
    sets = [g for g in members if not isinstance(g, str)]
    links = {g: [h for h in sets if h != g and len(g & h) * 5 >= 4 * len(g | h)] if not isinstance(g, str) else [] for g in members}
    return members, links


def near_groups(members, links):
    seen = {}
    for g in members:
        if g not in seen:
            todo, group = [g], {g}
            while todo:
                for h in links[todo.pop()]:
                    if h not in group:
                        group.add(h)
                        todo.append(h)
            seen |= dict.fromkeys(group, group)
    return seen


def brute_near(texts):
    members, links = near_classes(texts)
    rep = {g: min((texts[k][0] for k in ks if texts[k][0] is not None), default=None) for g, ks in members.items()}
    groups = near_groups(members, links)
    return Counter((texts[k][0], rep[g], len(links[g]), min((rep[h] for h in groups[g] if rep[h] is not None), default=None)) for g in members for k in members[g])


def test_near_duplicates(spark, corpus, docs, empty, monkeypatch):
    assert Counter(map(tuple, near_duplicates.near_duplicates(docs).collect())) == brute_near(corpus)
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    assert Counter(map(tuple, near_duplicates.near_duplicates(docs).collect())) == brute_near(corpus)
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert near_duplicates.without_near_duplicates(empty).count() == 0


def nameless(rng):
    """Near copies without an id, one id with different texts, texts without words, repeated rows."""
    x, y, z = (prose(rng, 12) for _ in range(3))
    odd = lambda t, n: " ".join(w if k != n else "odd" for k, w in enumerate(t.split()))
    return [(1, x, "s"), (3, y, "s"), (3, odd(x, 5), "s"), (None, z, "s"), (None, odd(z, 9), "s"), (None, odd(z, 9), "t"), (None, odd(x, 20), "s"), (None, prose(rng, 6), "s")] + [
        (None, "!!!", "s"),
        (None, "!!!", "s"),
        (None, "??", "s"),
        (8, "!!!", "s"),
        (9, None, "s"),
        (9, "", "s"),
        (3, y, "s"),
    ]


def test_rows_without_an_id_are_linked_and_deduplicated(spark, corpus):
    rng = random.Random(12)
    for texts in (nameless(rng), list(reversed(nameless(rng))), corpus):
        docs = rows_of(spark, texts)
        assert Counter(map(tuple, near_duplicates.near_duplicates(docs).collect())) == brute_near(texts)
        out = near_duplicates.without_near_duplicates(docs)
        assert out.columns == docs.columns
        members, links = near_classes(texts)
        groups = {frozenset(texts[k][1] or "" for g in group for k in members[g]): [texts[k][0] for g in group for k in members[g]] for group in near_groups(members, links).values()}
        kept = out.collect()
        assert len(kept) == len(groups)
        for alike, ids in groups.items():
            assert [r.doc_id for r in kept if (r.text or "") in alike] == [min((i for i in ids if i is not None), default=None)]


def test_bayesian_cut_keeps_the_threshold():
    for k, least in near_duplicates.least_matches():
        assert sum(math.comb(k, m) * 0.8**m * 0.2 ** (k - m) for m in range(least)) < 1e-6 and least > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (51, 50), (60, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


# 9


def test_toxicity(spark, empty):
    rng = random.Random(3)
    bad = ["glorp", "snark", "vrekt"]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(VOCAB, k=rng.randint(20, 120))
        toxic = i % 8 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "glorp", "s")]
    docs, known = rows_of(spark, rows), spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, known)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert 200 < len(held) < 400
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) > 0.98
    kept = toxicity.without_toxic(docs, toxicity.train(docs, known))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    nothing = toxicity.train(docs, known.where("doc_id < 0"))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.0}
    assert toxicity.scored(empty, nothing).count() == 0


def brute_kneser_ney(train, corpus):
    """P(w | v, class) by plain loops over the definition in the module's docstring."""
    c = {0: Counter(), 1: Counter()}
    for text, y in train:
        words = ["<start>", *re.findall(r"\w+", text.lower())]
        c[y].update(zip(words, words[1:]))
    held = Counter(w for t in corpus for w in set(re.findall(r"\w+", (t or "").lower())))
    known = {w for y in (0, 1) for p in c[y] for w in p}

    def q(w):
        return (held.get(w, 0) + 1) / (sum(held.values()) + len(held) + 1)

    both = Counter(w for _, w in set(c[0]) | set(c[1]))
    n1, n2 = (sum(x == k for x in both.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 else 0.5

    def shared(w):
        n, total = both.get(w, 0), sum(both.values())
        return (n - min(n, d) + sum(min(x, d) for x in both.values()) * q(w)) / total

    def single(w, y):
        left = Counter(w for _, w in c[y])
        off = lambda x: min(x, toxicity.MARGIN[0] * math.sqrt(x))
        n, total = left.get(w, 0), sum(left.values())
        return (n - off(n) + sum(map(off, left.values())) * shared(w)) / total

    def pair(v, w, y):
        off = lambda x: min(x, toxicity.MARGIN[1] * math.sqrt(x))
        row = {b: n for (a, b), n in c[y].items() if a == v}
        if not row:
            return single(w, y)
        n = row.get(w, 0)
        return (n - off(n) + sum(map(off, row.values())) * single(w, y)) / sum(row.values())

    return pair, known, held


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(VOCAB[:9] + (["glorp"] if i % 2 else []), k=400 + i)), "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _, _ in texts] + [(1, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    corpus = [*texts, (900, "words that no label has", "s"), (901, None, "s"), (902, "ta", "s")]
    docs = rows_of(spark, corpus)
    _, sizes, counts = toxicity.counted(docs, labels, toxicity.SAMPLE)
    model = counts.model(tuple(sizes.sum(1)))
    out = {r.doc_id: r.held_out for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    pair, known, held = brute_kneser_ney([(t, i % 2) for i, t, _ in texts if not out[i]], [t for _, t, _ in corpus])
    for text in (texts[0][1], texts[7][1], "words that GLORP never kata seen"):
        words = re.findall(r"\w+", text.lower())
        hashes = [toxicity.word_hash(w) for w in words]
        got = model.probabilities(hashes)
        assert model.scorer().ratios(words) == pytest.approx(np.log(got[1] / got[0]), abs=1e-5)
        for k, (v, w) in enumerate(zip(["<start>", *words], words)):
            for y in (0, 1):  # a word that the sample lacks has the share of one that no document holds
                assert got[y, k] == pytest.approx(pair(v, w if w in known else "<none>", y), rel=1e-9)
    for v in [*sorted(known), "<none>"]:  # the words of the corpus and one unknown word share all mass
        for y in (0, 1):
            assert sum(pair(v, w, y) for w in [*held, "<none>"]) == pytest.approx(1)
    assert len(model.words) == len(known) and len(model.keys) > 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = rows_of(spark, [(i, "bad word" if i % 2 else "good word", "s") for i in range(80)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.scored(docs, toxicity.train(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


# very long texts


def test_very_long_texts(spark, model):
    rng = random.Random(9)
    long = " ".join(rng.choices(VOCAB, k=300_000))
    pages = spark.createDataFrame([(2, "u", long), (1, "u", long), (3, "u", "x")], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in warc.deduplicated_pages(pages).collect()} == {(1, len(long), None), (2, len(long), 1), (3, 1, None)}
    turns = spark.createDataFrame([(0, 0, "user", long), (0, 1, "assistant", long), (1, 0, "user", long)], "conv_id long, turn long, role string, text string")
    pair = format_preferences(turns, F.lit(0), F.col("conv_id") == 1).first()
    assert pair.prompt_turns == 1 and pair.chosen[pair.chosen_mask[0].start : pair.chosen_mask[0].stop] == long + "<|end|>\n" and pair.rejected == ""
    docs = rows_of(spark, [(1, long, "s"), (2, "x", "s")])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") == 2).cast("int").alias("toxic"))
    assert toxicity.scored(docs, toxicity.train(docs, labels)).count() == 2
    own = LongestMatchCounter.of(model)
    counted = next(r for r in token_counts(docs, PIECE_MODEL).collect() if r.doc_id == 1)
    assert (counted.n_words, counted.n_tokens) == (300_000, sum(map(own.count, long.split())))
