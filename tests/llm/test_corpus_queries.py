"""The registered corpus queries: against their SQL where they have one, else whole results that rerun alike."""

import os

import pytest

from papyra.llm import mixing
from papyra.llm import queries as Q

DATA = os.environ.get("PAPYRA_TESTDATA", "/root/testdata") + "/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    res = con.sql(Q.oracle_sql()[name])
    at = [res.columns.index(c) for c in cols]
    assert sorted(res.columns) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql(spark, name):
    first = Q.queries()[name](spark, DATA).collect()
    if name in ("op4_decontaminate", "op9_simhash", "op10_pii"):
        assert sorted(map(repr, first)) == sorted(map(repr, Q.queries()[name](spark, DATA).collect()))
    rows = spark.read.parquet(f"{DATA}/{'pages' if name == 'op2_html' else 'documents'}.parquet").count()
    assert len(first) == rows or name == "op4_decontaminate"


def test_weights_of_documents(spark):
    """With weights of their own, documents are taken in proportion, and the source still meets its target."""
    docs = spark.createDataFrame([(i, "w " * 10, "s", 0.5 if i % 2 else 1.5) for i in range(2000)], "doc_id long, text string, source string, q double")
    got = mixing.mix(docs, weights=[1], share=0.5, weight="q").collect()
    taken = {k: sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1)}
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 10
    assert 2.6 < taken[0] / taken[1] < 3.4
