import pytest
from pyspark.sql import functions as F

import brute
from compare import connect, differences
from wayfare.llm import line_dedup, queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert differences(queries.op2_line_dedup(spark, d), connect(d), queries.ORACLE_SQL["op2_line_dedup"]) == []


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_equals_brute_force(spark, documents, hard, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    for docs, ratio, least in ((documents, 0.02, 3), (hard, 0.1, 2)):
        rows = docs.collect()
        want = brute.boilerplate([(r.source, r.text) for r in rows], ratio, least)
        got = line_dedup.drop_boilerplate(docs, F.col("source"), ratio=ratio, min_pages=least)
        key = lambda x: (str(x[0]), str(x[1]))
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(((r.doc_id, t) for r, t in zip(rows, want, strict=True)), key=key)
        assert any(t != r.text for r, t in zip(rows, want, strict=True))


def test_columns_and_empty_table(hard, empty):
    got = line_dedup.drop_boilerplate(empty, F.col("source"))
    assert got.collect() == [] and set(got.columns) == {*empty.columns, "n_dropped"}
    row = line_dedup.drop_boilerplate(hard, F.col("source"), min_pages=2).where("doc_id = 12").first()
    assert (row.n_lines, row.n_dropped) == (3, 0)


def test_host_of(spark):
    urls = ["https://User@Example.COM:8080/a?b", "http://x.org", "no url", None, "ftp://h/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["example.com", "x.org", None, None, "h"]
