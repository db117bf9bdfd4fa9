"""Rows of plain HTML tables are taken apart without the parser, and alike."""

import random

import pytest

from wayfare.sources import html

#: Pieces of documents; those behind the first 21 are odd.
PIECES = ["<table>", "</table>", "<tr>", "<tr class='a b'>", "</tr>", "<td>", "</td>", "<th>", "</TH >", "<br>", "<p>", "<b>", "text", "&amp;", "&lt", " \n", "<tr><td>a &amp; b</td><td> </td></tr>", "<tr class='y'><td>x</td></tr>tail", "<tr><th>x</th><th>y</th></tr>", "<tr><th>x</th><td>y</td></tr>", "<tr><td> <b>P&amp</b>;</td><td><i>x</td></tr>", "<td/>", "<br/>", "<", "a<b", ">", "<!-- c -->", "<script>", "</script>", "<title>", "<tr class>", "<tr class=z>", "</", "<!DOCTYPE html>"]


def parsed(text):
    p = html._Rows()
    p.feed(text)
    p.close()
    return p.rows


def test_alike():
    draw, plain = random.Random(5), 0
    for _ in range(8_000):
        text = "".join(draw.choices(PIECES if draw.random() < 0.3 else PIECES[:21], k=draw.randint(1, 14)))
        got = html._plain_rows(text)
        plain += got is not None
        assert got is None or got == parsed(text), text
    assert plain > 2_000


@pytest.mark.parametrize("odd, at", [("<!-- <tr><td>a</td></tr> -->", 0), ("<script><tr><td>a</td></tr></script>", 0), ("<td/>", 0), ("", 1)])
def test_oddities_are_parsed(monkeypatch, odd, at):
    monkeypatch.setattr(html._Rows, "feed", lambda self, text: None)
    got = html._plain_rows(f"<table><tr><td>1</td></tr></table>{odd}")
    assert (got is None) == (at == 0)


def test_many_rows(spark, monkeypatch):
    text = "<table>" + "".join(f"<tr class='c'><td>{i}</td></tr>" for i in range(45_001)) + "</table>"
    rows = html.table_rows(spark.createDataFrame([("d", text), ("e", None), ("f", "<table><tr><td>x</table>")], "document string, html string"), ["document"])
    got = rows.selectExpr("document", "row", "row_class", "cells[0] AS c").collect()
    assert [(r.row, r.c) for r in got] == [(i, str(i)) for i in range(45_001)] and {(r.document, r.row_class) for r in got} == {("d", "c")}


def test_places_by_their_digits(spark):
    from pyspark.sql import functions as F

    from wayfare.functions import text

    xs = ["001122N 0112233E", "895959S 1795959W", "900000N 1800000E", "900001S 1800001W", "990000N 1990000E", "001122n 0112233e", "001122N  0112233E", "001122N0112233E", "001122.5N 0112233.25W", "001122N 0112233E\n", " 001122N 0112233E", "0112233E 001122N", "001199N 0118899W", "1°2'3\"N 4°5'6\"W", "nil", "", None]
    df = spark.createDataFrame([(x,) for x in xs], "x string").select("x", F.struct(*(c.alias(n) for n, c in zip(("lat", "lon"), text.coordinate_pair(F.col("x")), strict=True))).alias("want"), text.coordinate_place(F.col("x")).alias("got"))
    for r in df.collect():
        assert (r.got or (None, None)) == tuple(r.want), r.x
