from wayfare.operators import search


def test_queries_in_blocks(spark, monkeypatch):
    """Queries give the same rows whatever the size of a block; repeated ones count once, null ones not at all."""
    rows = [(i, f"A{chr(65 + i % 26)}{chr(65 + i // 26)}", None if i % 3 else f"K{i:03}", f"ID{i}", f"Port {i % 7}", "Town", "XX", "large_airport" if i % 5 else "small_airport", i % 2 == 0) for i in range(120)]
    airports = spark.createDataFrame(rows, "id int, iata string, icao string, ident string, name string, municipality string, country string, type string, scheduled boolean")
    asked = lambda *texts: spark.createDataFrame([(t,) for t in texts], "q string")
    texts = ["aaa", "Port", "", "k00", "own", "nothing here", "ID1"]
    want = sorted(map(tuple, search.search(airports, asked(*texts)).collect()))
    assert {r[0] for r in want} == set(texts) - {"nothing here"} and max(r[1] for r in want) == 40
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, search.search(airports, asked(*texts, "aaa", None)).collect())) == want
    assert search.search(airports, asked()).collect() == []
    assert "CartesianProduct" not in (plan := search.search(airports, asked("a"))._jdf.queryExecution().toString()) and "NestedLoop" not in plan
