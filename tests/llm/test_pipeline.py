"""The pipeline's result against a brute-force version of every stage, on the smallest tables."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_operators import awkward, brute_groups, brute_mix, brute_words, empty, naive_tiles
from tracewell.llm import bpe, decontam, quality, queries
from tracewell.llm.textvec import raw

SF = "/root/testdata/sf0.001"


def brute(sf_dir):
    import numpy as np

    con = duckdb.connect()
    read = lambda t, c: con.execute(f"SELECT {c} FROM '{sf_dir}/{t}.parquet'").fetchall()
    rows = read("documents", "doc_id, text, source, lang")
    labels = [x for x in read("labels", "doc_id, quality") if x[1] in (0, 1)]
    x = {r[0]: quality.statistics(*raw(pa.array([r[1]])))[0] for r in rows}
    n, s = np.zeros(2), np.zeros((2, len(quality.FEATURES)))
    p = np.zeros((2, len(quality.FEATURES), len(quality.FEATURES)))
    for i, y in labels:
        if i in x:
            n[y] += 1
            s[y] += x[i]
            p[y] += np.outer(x[i], x[i])
    model = quality.model_of(n, s, p)
    rows = [r for r in rows if x[r[0]][0] > 0 and model.low_odds(x[r[0]][None])[0] <= quality.THRESHOLD]
    yield "quality", rows
    groups = brute_groups([r[:3] for r in rows])
    rows = [r for r in rows if groups.get(r[0], r[0]) == r[0]]
    yield "near_duplicates", rows
    tok = brute_words
    items = [tok(t) for _, t in read("benchmark", "item_id, text")]
    grams = [{tuple(b[k : k + decontam.TILE]) for k in range(len(b) - decontam.TILE + 1)} for b in items]

    def leaks(t):
        d = tok(t)
        seen = {tuple(d[k : k + decontam.TILE]) for k in range(len(d) - decontam.TILE + 1)}
        return any(g & seen and sum(m[2] for m in naive_tiles(b, d, decontam.TILE)) >= decontam.COVERAGE * len(b) for b, g in zip(items, grams))

    rows = [r for r in rows if not leaks(r[1])]
    yield "decontamination", rows
    coder = bpe.load()
    kept = {i for i, *_ in brute_mix([r[:3] for r in rows], tokens=lambda t: len(coder.encoding.encode_ordinary(t)))}
    rows = [r for r in rows if r[0] in kept]
    yield "mixing", rows
    yield "tokens", [(i, s, lang, coder.encoding.encode_ordinary(t)) for i, t, s, lang in rows]


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), (want_name, want) in zip(corpus_pipeline.STAGES, brute(SF), strict=True):
        assert name == want_name
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == columns
            assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == Counter(r[0] for r in want), name
            assert want
    assert Counter((r.doc_id, r.source, r.lang, r.n_tokens, tuple(r.tokens)) for r in docs.collect()) == Counter((i, s, lang, len(t), tuple(t)) for i, s, lang, t in want)
    assert corpus_pipeline.run(spark, SF).count() == len(want)


def test_stages_decide_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").first().text
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (1, text), (None, item), (2, item), (2, "a clean text of the same id")], "doc_id long, text string")
    left = corpus_pipeline.decontamination(spark, corpus_pipeline.near_duplicates(spark, docs, SF), SF)
    assert Counter(tuple(r) for r in left.collect()) == Counter([(1, text), (2, "a clean text of the same id")])


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("awkward", awkward(spark, extra=True)), ("empty", empty(spark))):
        columns, n = docs.columns, docs.count()
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert docs.count() <= n, stage
            assert docs.columns == (columns if stage != "tokens" else ["doc_id", "source", "lang", "n_tokens", "tokens"])
            n = docs.count()
        assert (n > 0) == (name == "awkward")
        assert docs.where("tokens IS NULL OR n_tokens <> size(tokens) OR n_tokens = 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(map(str, r)) for r in got.select(*names).collect()) == Counter(tuple(map(str, r)) for r in want.fetchall())


def test_planted_leaks_and_labels(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    whole = {(d, i) for d, t in docs for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    assert whole <= got
    bad = {i for (i,) in con.execute(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 0").fetchall()}
    good = {i for (i,) in con.execute(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()}
    kept = {r.doc_id for r in queries.QUERIES["op6_quality_classifier"](spark, SF).where("keep").collect()}
    assert len(kept & good) >= 0.98 * len(good) and len(kept & bad) <= 0.1 * len(bad)
