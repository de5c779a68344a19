"""The stages in turn against brute force, and the queries as registered."""

import duckdb
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from tidefolio.llm import queries as Q, toxicity
from tidefolio.llm.simhash import near_duplicates

from .test_secrets import plain
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(Q.QUERIES) < set(registry.queries()) and "pipeline" in registry.queries()
    assert [n.split("_")[0] for n in Q.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    answer = con.execute(Q.ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in answer.fetchall()]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_simhash_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    values = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = plain_components(values)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{v:016x}", roots[i]) for i, v in values.items()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held, columns = docs, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in held.collect()} if "text" in held.columns else {}
        out = stage(spark, held, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        held = spark.read.parquet(path)
        after = held.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert held.columns == columns
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
            assert {r.doc_id for r in after} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            values = {i: plain_fingerprint(r.text) for i, r in before.items()}
            assert sorted(r.doc_id for r in after) == sorted(set(plain_components(values).values()))
            assert near_duplicates(held).select("component_id").distinct().count() == len(after)
        elif name == "secrets":
            assert {r.doc_id for r in after} == set(before)
            for r in after:
                assert (r.text == before[r.doc_id].text) == (not plain(before[r.doc_id].text))
        elif name == "mixing":
            assert {r.doc_id for r in after} <= set(before) and all(len(r.text) <= len(before[r.doc_id].text) for r in after)
        else:
            assert held.columns == ["doc_id", "source", "ids", "n_pieces"] and all(len(r.ids) == r.n_pieces for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "source", "ids", "n_pieces"]
