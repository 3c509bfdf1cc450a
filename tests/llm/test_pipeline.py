"""The pipeline on a small folder of tables, stage by stage, against brute force."""

from __future__ import annotations

import random

import corpus_pipeline as P
import duckdb
import pytest
from test_operators import brute_components, brute_exact, brute_hits, corpus, words

from quillframe.llm import queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in corpus(9)] + [(500 + k, " | ".join(words(rng, 40).split()), "en", "s1", 9) for k in range(30)]
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0), (602, "leaked " + words(random.Random(2), 12) + " text", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if 500 <= r[0] < 530 else 1, 0) for r in rows[::1]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, words(random.Random(2), 12))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = P.quality(spark, docs, folder)
    scores = {r["doc_id"] for r in queries.op9_quality(spark, folder).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == scores
    kept = P.exact(spark, good, folder)
    want = {r[0] for r in brute_exact([(r["doc_id"], r["text"]) for r in good.collect()]) if r[3]}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    apart = P.near(spark, kept, folder)
    want = [k for k, _, c in brute_components([(r["doc_id"], r["text"]) for r in kept.collect()], 80, 5) if k == c]
    assert apart.columns == docs.columns and sorted(r["doc_id"] for r in apart.collect()) == sorted(want)
    clean = P.decontaminated(spark, apart, folder)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [r["doc_id"] for r in apart.collect() if not brute_hits(r["text"], items, 10)[1]]
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(want)
    assert 602 not in want
    last = P.mixed(spark, clean, folder)
    assert set(docs.columns) < set(last.columns) and last.where("rate < 0").count() == 0 and last.count() == len(want)


def test_near_by_five_words(spark, folder):
    base = [f"w{k}" for k in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:25], "changed", *base[26:]]))]  # 41 of 51 at five words, 43 of 51 at four
    rows += [(10 + i, t) for i, t, _ in corpus(12)]
    rows += [(100, " ".join(base[:24] + base[26:])), (101, " ".join(f"v{k}" for k in range(40))), (102, " ".join([*(f"v{k}" for k in range(20)), "changed", *(f"v{k}" for k in range(21, 40))]))]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [k for k, _, c in brute_components(rows, 80, 5) if k == c]
    assert 2 not in want and {1, 101, 102} <= set(want)
    assert sorted(r["doc_id"] for r in P.near(spark, docs, folder).collect()) == sorted(want)


def test_run(spark, folder):
    ids = [r["doc_id"] for r in P.run(spark, folder).select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 10


def test_repeated_rows_stay_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.union(docs)
    kept = P.exact(spark, twice, folder)
    assert kept.count() == P.exact(spark, docs, folder).count()


def test_odd_rows_in_every_stage(spark, folder):
    """Null and repeated ids, very long texts, and columns named like those that the stages make."""
    rng = random.Random(21)
    texts = [words(rng, 40) for _ in range(6)]
    leak = "leaked " + words(random.Random(2), 12) + " text"
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (3, texts[3]), (5, texts[3]), (5, texts[4]), (None, leak), (5, leak + " again"), (7, long), (8, long + " tail"), (9, None), (None, None), (10, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_row string, kept_id string, row string, uid string, rate string, `a b` string"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "u", "r", "s") for i, t in rows], schema)
    key = lambda df: sorted(((r["doc_id"], (r["text"] or "")[:50]) for r in df.collect()), key=str)
    short = lambda pairs: sorted(((i, (t or "")[:50]) for i, t in pairs), key=str)
    assert P.quality(spark, docs, folder).columns == docs.columns
    kept = P.exact(spark, docs, folder)
    assert kept.columns == docs.columns
    assert key(kept) == short([(1, texts[0]), (None, texts[1]), (5, texts[2]), (3, texts[3]), (5, texts[4]), (None, leak), (5, leak), (7, long), (8, long), (9, None)])
    apart = P.near(spark, docs, folder)
    assert apart.columns == docs.columns
    assert key(apart) == short([(1, texts[0]), (None, texts[1]), (5, texts[2]), (3, texts[3]), (5, texts[4]), (5, leak), (7, long), (9, None), (None, None), (10, "")])
    clean = P.decontaminated(spark, docs, folder)
    assert clean.columns == docs.columns and key(clean) == short([r for r in rows if not (r[1] or "").startswith("leaked")])
    last = P.mixed(spark, docs, folder)
    assert last.count() == len(rows) and set(docs.columns) < set(last.columns)


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.queries()[name](spark, d)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda names, rows: sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert key(got.columns, got.collect()) == key(want.columns, want.fetchall())


def test_native_mixing_runs_no_python(spark, folder):
    plan = queries.op1_mixing(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
