"""Every row of a document has one fate, and dropped rows are issues."""

import pytest

from wayfare import catalog
from wayfare.sources import charts, fixed_width, publications


def counted(df, column):
    return {r[0]: r["count"] for r in df.groupBy(column).count().collect()}


ROUTES = (
    "<table><tr class='t-0'><td>see below</td></tr><tr class='t type-1'><td>A1</td></tr>"
    "<tr class='t type-2'><td>ALPHA</td><td>100000N 0200000E</td></tr><tr class='t type-3'><td>12 NM</td></tr>"
    "<tr class='t type-2'><td>BRAVO</td><td>990000N 0210000E</td></tr><tr class='t type-2'><td>-</td><td>110000N 0210000E</td></tr>"
    "<tr class='t type-2'><td>-</td><td>nil</td></tr><tr class='t type-2'><td>DELTA</td><td>120000N 0220000E</td></tr></table>"
)
POINTS = "<table><tr><td>ECHO</td><td>100000N 0200000E</td></tr><tr><td>-</td><td>110000N 0200000E</td></tr><tr><td>FOX</td><td>950000N 0200000E</td></tr><tr><td>Name</td><td>Place</td></tr></table>"


def test_publication(spark):
    pages = spark.createDataFrame([("enr_3_1", ROUTES), ("enr_4_4", POINTS), ("enr_3_2", None), ("enr_3_3", "")], "document string, html string")
    want = {"route": 1, "stop": 2, "distance": 1, "outside-route": 1, "route-coordinate": 1, "route-ident-missing": 1, "route-coordinate-missing": 1, "point": 1, "point-ident-missing": 1, "point-coordinate": 1, "no-coordinate": 1}
    assert counted(publications.fates(pages, "hongkong"), "fate") == want
    t = publications.tables(pages, "hongkong")
    assert counted(t.issues, "code") == {c: n for c, n in want.items() if c in publications.FAULTS}
    assert sorted(r.ident for r in t.points.collect()) == ["ALPHA", "DELTA", "ECHO"] and [r.distance_nm for r in t.segments.collect()] == [12.0]


def test_records(spark):
    line = lambda key, *parts: "".join(f"{p:{n}}" for p, n in ((f"SUSA{key}", 13), *parts)).ljust(132)
    lines = ["", "HDR01", "short", line("EA", ("ALPHA", 19), ("N40000000W100000000", 19)), line("EA", ("BRAVO", 19)), line("EA", ("", 19), ("N40000000W100000000", 19)), line("ER", ("J5", 12), ("0010", 4), ("ALPHA", 5)), line("ER", ("J5", 12), ("ten", 4), ("ALPHA", 5)), line("UC"), None]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, line string")
    want = {"blank": 2, "header": 1, "record-short-line": 1, "point": 1, "record-parse": 3, "stop": 1, "other-record": 1}
    assert counted(fixed_width.fated(df), "fate") == want
    assert counted(fixed_width.records(df, "faa").issues, "code") == {"record-short-line": 1, "record-parse": 3}


def test_chart(spark):
    text = "A1\nALPHA 100000N 0200000E\n10 NM\nBRAVO 990000N 0200000E\n110000N 0210000E\nDELTA 120000N 0220000E\n"
    t = charts.tables(spark.createDataFrame([("enr_3_1", text), ("enr_4_4", "ECHO 100000N 0300000E\n- 100000N 0310000E"), ("enr_3_2", None)], "document string, text string"), "cuba")
    assert counted(t.issues, "code") == {"route-coordinate": 1, "route-ident-missing": 1, "point-ident-missing": 1}
    assert sorted(r.ident for r in t.points.collect()) == ["ALPHA", "DELTA", "ECHO"]


def test_chart_places(spark):
    """Publishers write places close together, in lines of their own, or apart."""
    text = {"kuwait": "100000N0200000E", "cuba": "100000N\n0200000E", "mauritius": "10 00 00 N 020 00 00 E", "maldives": "10° 00’ 00” N 020° 00’ 00” E"}
    for publisher, place in text.items():
        df = spark.createDataFrame([("enr_3_1", f"A1\nALPHA {place}\nBRAVO {place.replace('10', '11', 1)}\n")], "document string, text string")
        assert [(r["sequence"], r.distance_nm) for r in charts.tables(df, publisher).segments.collect()] == [(1, 60.04)], publisher


def test_rows_are_searched_once(spark):
    """What a row's text tells is written down before windows, points, airways and segments read it, and rows are fated once."""
    pages = spark.createDataFrame([("enr_3_1", ROUTES), ("enr_4_4", POINTS)], "document string, html string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not any(x in plan(publications.fates(pages, p)) for p in ("uk", "hongkong", "india") for x in ("regexp", "rlike"))
    t = publications.tables(pages, "uk")
    assert "regexp_extract" not in plan(t.segments) and plan(t.points).count("window [") == 1


def test_heads_end_what_was_waiting(spark):
    """A head takes up no name or distance, and neither goes on into the next route."""
    html = "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in [("A1",), ("ALPHA", "100000N 0200000E"), ("7 NM",), ("BRAVO {x}",), ("T1;NIL",), ("B2",), ("", "110000N 0200000E"), ("ECHO", "120000N 0200000E"), ("  9 \n NM",), ("FOX", "130000N 0200000E")])
    rows = publications.fates(spark.createDataFrame([("enr_3_1", f"<table>{html}</table>")], "document string, html string"), "uk").orderBy("row")
    assert [r.fate for r in rows.collect()] == ["route", "stop", "distance", "name", "name", "route", "route-ident-missing", "stop", "distance", "stop"]


@pytest.mark.parametrize("name", ["built_source", "publication_by_classes", "publication_fates"])
def test_queries_search_rows_once(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract" not in plan and "rlike" not in plan


def test_chart_points_are_found_once(spark):
    """Points are written down before stops, airways and legs read them, and joins carry no text of the chart."""
    t = charts.tables(spark.createDataFrame([("enr_3_1", "A1\nALPHA 100000N 0200000E\n10 NM\nBRAVO 110000N 0210000E\n")], "document string, text string"), "cuba")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(t.points) and "row_number" not in plan(t.points)
    assert "gap#" not in plan(t.segments).split("Join")[0] and [r.distance_nm for r in t.segments.collect()] == [10.0]
