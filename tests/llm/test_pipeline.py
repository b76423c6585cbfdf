"""The pipeline against its composed brute-force stages, and the operators' oracles on a small table."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_mix, brute_spans, near_classes, near_groups, prose, words_in

import __spark_entry__ as entry
import corpus_pipeline
from pathshade.llm import mixing, sentences, toxicity
from pathshade.llm.pieces import PieceModel, ViterbiEncoder
from pathshade.llm.queries import PIECE_MODEL
from pathshade.session import scratch

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _own string, spans string"


def rows(texts):
    return [(i, t, None, s, None if t is None else len(t), "x", "x", "x") for i, t, s in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with insults, near copies, shared passages, nulls in every column, empty and
    very long texts, repeated rows, rows without an id and extra columns."""
    rng = random.Random(21)
    texts, labels = [], []
    for i in range(260):
        words = prose(rng, rng.randint(3, 9)).split()
        if i % 6 == 0:
            words[len(words) // 2 : len(words) // 2] = [rng.choice(["glorp", "vrekt"]), "you", "glorp"]
        texts.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [t for i, t, _ in texts if i % 6]
    passage = prose(rng, 9)
    texts += [(300, clean[0], "s0"), (301, " ".join(w if n != 4 else "odd" for n, w in enumerate(prose(random.Random(1), 12).split())), "s1"), (302, prose(random.Random(1), 12), "s1")]
    texts += [(310 + n, f"{prose(rng, 2)} {passage} {prose(rng, 2)}", "s2") for n in range(3)] + [(320, prose(rng, 1200), None)]
    texts += [(330, None, "s0"), (331, "", None), (None, prose(rng, 5), "s0"), (None, prose(rng, 5), "s0"), (None, clean[1], "s1"), (332, " ", "s1"), texts[1], texts[1]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(texts), COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def brute_near_stage(texts):
    """One document of each group: of the smallest doc_id, null last."""
    members, links = near_classes(texts)
    kept = []
    for group in {id(g): g for g in near_groups(members, links).values()}.values():
        kept.append(min(((texts[k][0] is None, texts[k][0] or 0, texts[k]) for c in group for k in members[c]), key=lambda x: x[:2])[2])
    return kept


def taken_rows(spark, texts):
    out = []
    for n, words in brute_mix(spark, texts)[2]:
        i, t, s = texts[n]
        if words < len(words_in(t)):
            t = "".join(re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", t)[:words])
        out.append((i, t, s))
    return out


def test_run_against_brute_force(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = lambda t: model.score(toxicity.words_of(t)) >= 0.3
    assert sum(toxic(t) for i, t, _ in texts if i is not None and i < 260) == 44
    kept = [x for x in texts if not toxic(x[1])]
    assert 200 < len(kept) < len(texts)
    kept = brute_near_stage(kept)
    left = dict(brute_spans([(k, t) for k, (_, t, _) in enumerate(sorted(kept, key=lambda x: (x[0] is None, x[0] or 0)))]))
    order = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0))
    spanned = [(order[k][0], t, order[k][2]) for k, t in left]
    assert any(t != o[1] for (_, t, _), o in zip(sorted(spanned, key=str), sorted(order, key=str)))
    v = ViterbiEncoder(PieceModel.load(PIECE_MODEL))
    want = Counter((i, tuple(v.encode(t or "")[0])) for i, t, _ in taken_rows(spark, spanned))
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), path).count() == 0
        out = stage(spark, docs, path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            if n != 3:  # other columns come along
                assert {r[0] for r in out.select("spans").distinct().collect()} == {"x"}


def test_two_pipelines_in_one_session(spark, folder):
    path, _ = folder
    first = corpus_pipeline.run(spark, path)
    with scratch() as seen:
        again = corpus_pipeline.run(spark, path)
    assert Counter(map(str, first.collect())) == Counter(map(str, again.collect())) and seen


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        assert docs.count() > 0
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {"doc_id", "ids"} <= set(docs.columns)


@needs_data
@pytest.mark.parametrize("name", ["op1_warc_revisits", "op5_exact_topk", "op7_chat_preferences", "op8_jaccard_join"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want
