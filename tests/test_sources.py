"""Sources on small inputs of their own."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfare.sources import archives, canonical, charts, features, fixed_width, html, journeys, navdata, publications, reports, shapes, tabular


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id;name\n1;"a;""b""\nc"\n2;\n', encoding="utf-8")
    df = tabular.csv(spark, str(tmp_path / "a.csv"), sep=";")
    assert df.columns == ["id", "name"] and rows(df, "id", "name") == [("1", 'a;"b"\nc'), ("2", None)]
    none = tabular.optional(lambda: tabular.csv(spark, str(tmp_path / "none.csv")), spark, "id string")
    assert none.columns == ["id"] and none.collect() == []
    (tmp_path / "r.dat").write_text("BA,1,LHR,2,JFK,3,,0,747\nBA,1,LHR,2,JFK,3,,1,747\n\\N,1,XX,2,JFK,3,,0,747\n")
    assert rows(tabular.airline_routes(spark, str(tmp_path / "r.dat")), "airline", "origin", "destination") == [("BA", "LHR", "JFK")]
    x = spark.createDataFrame([("",), ("7",), ("x",), (None,)], "v string").select(tabular.number(F.col("v")).alias("a"), tabular.number_or_zero(F.col("v")).alias("b"))
    assert [tuple(r) for r in x.collect()] == [(None, 0.0), (7.0, 7.0), (None, None), (None, 0.0)]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/X-ENR-3.1.html", "é")
        z.writestr("other.txt", b"\xe9")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    files = archives.files(spark, str(tmp_path), "*.zip")
    got = archives.as_text(archives.zip_members(files, "ENR-3|other"))
    assert rows(got, "member", "text") == [("d/X-ENR-3.1.html", "é"), ("other.txt", "é")]
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "a" * 100)
    with pytest.raises(Exception, match="compressed"):
        archives.zip_members(archives.files(spark, str(tmp_path), "packed.zip"), stored_only=True).collect()


def test_dbf_and_shapes(spark):
    field = lambda name, size: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, 3, 32 + 64 + 1, 1 + 5 + 3).ljust(32, b"\0") + field("NAME", 5) + field("N", 3) + b"\r"
    dbf = head + b" Roma   1" + b"*Gone   2" + b" Oslo   3"
    got = shapes.dbf(spark.createDataFrame([("f", bytearray(dbf))], "path string, content binary"))
    assert [(r.ord, r.record) for r in got.collect()] == [(0, {"NAME": "Roma", "N": "1"}), (1, {"NAME": "Oslo", "N": "3"})]

    def record(number, kind, parts, points):
        body = struct.pack("<i4d", kind, 0, 0, 0, 0) + struct.pack("<ii", len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *parts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">ii", number, len(body) // 2) + body

    shp = b"\0" * 100 + record(1, 3, [0, 2], [(1, 2), (3, 4), (5, 6)]) + struct.pack(">ii", 2, 2) + struct.pack("<i", 0) + record(3, 5, [0], [(7, 8)])
    got = shapes.shapes(spark.createDataFrame([("f", bytearray(shp))], "path string, content binary"))
    assert rows(got, "record", "part", "ord", "lat", "lon") == [(1, 0, 0, 2.0, 1.0), (1, 0, 1, 4.0, 3.0), (1, 1, 0, 6.0, 5.0), (3, 0, 0, 8.0, 7.0)]


PAGE = "<p><a href='/x?a=1'>One <b>two</b></a><a name=q>no</a></p><table><tr class=h><th>A</th><td>b<br>c<table><tr><td>in</td></tr></table></td></tr></table><table><tr><td>z &amp; y</td></tr></table>"


def test_html(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, None), (3, "<a href=u>")], "doc int, html string")
    assert rows(html.anchors(docs, ["doc"]), "doc", "pos", "href", "label") == [(1, 1, "/x?a=1", "One two")]
    got = html.table_rows(docs, ["doc"])
    assert [(r.tbl, r.depth, r.row_class, r.cells) for r in got.orderBy("row").collect()][0] == (2, 2, "", ["in"])
    assert rows(html.table_rows(docs, ["doc"], table=3), "cells") == [(["z & y"],)]
    assert rows(html.table_rows(docs, ["doc"], depth=2), "cells") == [(["in"],)]


def table(rows_, css=None):
    return "<table>" + "".join(f"<tr class='{(css or {}).get(i, '')}'>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for i, r in enumerate(rows_)) + "</table>"


def test_publication_by_row_look(spark):
    points = table([["Name", "Coordinates"], ["ABBOT", "510000N 0010000W"], ["DVOR/DME 'KIL' KILO", "520000N 0010000W"]])
    route = table([["M185 (RNAV 5)"], ["ABBOT", "510000N 0010000W"], ["60.1 NM"], ["KILO DVOR/DME (KIL)", "520000N 0010000W"], ["KILO DVOR/DME (KIL)", "520000N 0010000W"], ["FL245"], ["NEWPT", "530000N 0010000W"], ["L9"], ["ABBOT", "510000N 0010000W"]])
    t = publications.tables(spark.createDataFrame([("ENR-4.4", points), ("ENR-3.1", route)], "document string, html string"), "uk")
    assert rows(t.points, "ident", "lat", "point_type") == [("ABBOT", 51.0, "SIGNIFICANT_POINT"), ("KIL", 52.0, "NAVAID"), ("NEWPT", 53.0, "SIGNIFICANT_POINT")]
    assert rows(t.airways, "designator", "route_type", "country", "fir") == [("M185", "RNAV 5", "GB", "LONDON")]
    assert rows(t.segments, "sequence", "distance_nm", "course_deg", "reverse_deg") == [(1, 60.1, 0.0, 180.0), (2, 60.04, 0.0, 180.0)]
    assert rows(t.issues, "code") == [("route-too-short",)]


def test_publication_by_row_class(spark):
    css = {0: "Table-row-type-1", 1: "Table-row-type-2", 2: "Table-row-type-3", 3: "Table-row-type-2", 4: "Table-row-type-2 AmdtDeleted", 5: "Table-row-type-1", 6: "Table-row-type-2"}
    route = table([["A1"], ["▲", "ALPHA", "220000N 1140000E"], ["123", "77 NM"], ["▲", "BRAVO", "230000N 1140000E"], ["▲", "GONE", "240000N 1140000E"], ["B2"], ["▲", "ALPHA", "220000N 1140000E"]], css)
    t = publications.tables(spark.createDataFrame([("enr_3_1", route)], "document string, html string"), "korea")
    assert rows(t.points, "ident") == [("ALPHA",), ("BRAVO",)]
    assert rows(t.segments, "distance_nm") == [(77.0,)]
    assert rows(t.airways, "designator") == [("A1",), ("B2",)] and rows(t.issues, "code") == [("route-too-short",)]


def test_publication_by_table(spark):
    one = table([["Route designator"], ["N571 (RNAV 10)"], ["▲", "FIRST", "010000N 1030000E"], ["", "111.12 KM", ""], ["▲", "SECON", "020000N 1030000E"]])
    two = table([["N572"], ["▲", "FIRST", "010000N 1030000E"]])
    t = publications.tables(spark.createDataFrame([("enr_3_1", one + two)], "document string, html string"), "vietnam")
    assert rows(t.airways, "designator", "route_type") == [("N571", "RNAV 10")]
    assert rows(t.segments, "distance_nm") == [(60.0,)] and rows(t.issues, "code") == [("route-too-short",)]


def test_chart_text(spark):
    text = "AIP\nA341\nSOMEP\n010000N 1030000E\nTrack 001 25.5 NM FL245\nTOWN (VJB)\n020000N 1030000E\nA342\nLONER\n010000N 1040000E\n"
    t = charts.tables(spark.createDataFrame([("enr_3_1", text)], "document string, text string"), "malaysia")
    assert rows(t.points, "ident", "point_type") == [("LONER", "SIGNIFICANT_POINT"), ("SOMEP", "SIGNIFICANT_POINT"), ("VJB", "NAVAID")]
    assert rows(t.segments, "distance_nm") == [(25.5,)] and rows(t.airways, "designator", "route_type") == [("A341", "ATS")]
    text = "T1\n(RNAV 5)\nALFAX\n550000N 0100000E\n012 ° / 192 °\n31.5\nBRAVO\n560000N 0100000E\n012 ° / 192 ° 44.4\nCHARL\n570000N 0100000E\nTotal DIST\n012 ° / 192 ° 99.9\n"
    t = charts.tables(spark.createDataFrame([("enr_3_2", text)], "document string, text string"), "denmark")
    assert rows(t.segments, "sequence", "distance_nm") == [(1, 31.5), (2, 44.4)] and rows(t.airways, "route_type") == [("RNAV 5",)]
    text = "UM1\n480000N 0020000E ABCDE\n|FL195\n490000N 0020000E (PON)\nx"
    t = charts.tables(spark.createDataFrame([("enr_3_3", text)], "document string, text string"), "france")
    assert rows(t.points, "ident", "point_type") == [("ABCDE", "SIGNIFICANT_POINT"), ("PON", "NAVAID")]


def test_chart_blocks(spark):
    blocks = [
        ("d", 0, 90.0, 10.0, 200.0, 20.0, "V 500 RNAV"), ("d", 0, 90.0, 50.0, 140.0, 60.0, "ABUPI"), ("d", 0, 200.0, 55.0, 300.0, 65.0, "33° 00' 00'' S 070° 00' 00'' W"),
        ("d", 0, 90.0, 120.0, 140.0, 130.0, "TOSOR"), ("d", 0, 200.0, 120.0, 300.0, 130.0, "34° 00' 00'' S 070° 00' 00'' W"), ("d", 1, 200.0, 10.0, 300.0, 20.0, "35° 00' 00'' S 070° 00' 00'' W"),
    ]
    t = charts.block_tables(spark.createDataFrame(blocks, "document string, page int, x0 double, y0 double, x1 double, y1 double, text string"), "chart", "CL", "SANTIAGO", "south-america")
    assert rows(t.points, "ident", "lat") == [("ABUPI", -33.0), ("TOSOR", -34.0)]
    assert rows(t.segments, "distance_nm", "course_deg", "reverse_deg") == [(60.04, 180.0, 0.0)]
    assert rows(t.airways, "designator", "route_type") == [("V500", "RNAV")] and rows(t.issues, "code") == [("route-missing",)]


def test_csv_segments(spark):
    p = spark.createDataFrame([(1, "ADUXO", "400000N", "0040000W")], "ord int, Identificador_Identifier string, Latitud_Latitude string, Longitud_Longitude string")
    n = spark.createDataFrame([(1, "BRA", "410000N", "0040000W", "BARAHONA")], "ord int, Identificador_Identifier string, Latitud_Latitude string, Longitud_Longitude string, Nombre_Name string")
    s = spark.createDataFrame(
        [(1, "UN10", "ADUXO", "400000N", "0040000W", "DVOR/DME X (BRA)", "410000N", "0040000W", "60,5", "", "", "195", "FL", "", "X", "5"), (2, "UN10", "BRA", "410000N", "0040000W", "NUEVO", "420000N", "0040000W", "", "12,5", "", "2000", "FT", "X", "X", "5"), (3, "UN11", "", "", "", "BRA", "410000N", "0040000W", "", "", "", "", "", "", "", "")],
        "ord int, DESIGNATOR_TXT string, PUNTO_INICIO string, COOR_LAT_INICIO string, COOR_LON_INICIO string, PUNTO_FINAL string, COOR_LAT_FINAL string, COOR_LON_FINAL string, LENGTH_VAL string, MAGTRACK_VAL string, REVERSEMAGTRACK_VAL string, DISTVERTUPPER_VAL string, DISTVERTUPPER_UOM string, DIRECTION_CODE_IMPAR_ODD string, DIRECTION_CODE_PAR_EVEN string, PBNACCURACY_VAL string",
    )
    t = reports.csv_tables(p, n, s, "es", "ES", "SPAIN", "europe")
    assert rows(t.points, "ident", "name") == [("ADUXO", "ADUXO"), ("BRA", "BARAHONA"), ("NUEVO", "NUEVO")]
    assert rows(t.segments, "sequence", "distance_nm", "course_deg", "reverse_deg", "upper_ft", "direction") == [(1, 60.5, 0.0, 180.0, 19500.0, "even"), (2, 60.04, 12.5, 192.5, 2000.0, "bidirectional")]
    assert rows(t.issues, "code") == [("route-point-missing",)]


def test_report(spark):
    r = table([["id", "x"]]) + table([["1", "UL9", "EUR", "AAA", "VOR", "BBBBB", "WPT"], ["2", "UL9", "EUR", "BBBBB", "WPT", "NOPOS", "WPT"], ["3", "UL9", "EUR", "AAA", "VOR", "AAA", "VOR"]])
    known = spark.createDataFrame([("AAA", 50.0, 1.0, 2), ("AAA", 50.0, 0.0, 1), ("BBBBB", 51.0, 0.0, 3)], "ident string, lat double, lon double, priority int")
    t = reports.report_tables(spark.createDataFrame([("d", r)], "document string, html string"), "rep", known)
    assert rows(t.points, "ident", "lon", "point_type") == [("AAA", 0.0, "NAVAID"), ("BBBBB", 0.0, "SIGNIFICANT_POINT")]
    assert rows(t.segments, "distance_nm") == [(60.04,)] and rows(t.airways, "route_type") == [("RNAV",)] and rows(t.issues, "message") == [("NOPOS",)]


def fixed(key, **at):
    line = list("SUSA" + key + " " * 126)
    for start, value in at.items():
        i = int(start[1:])
        line[i : i + len(value)] = value
    return "".join(line)


def test_fixed_width(spark, tmp_path):
    text = "\n".join(
        [
            "HDR01", "short",
            fixed("EA", c13="ALPHA", c19="K1", c32="N40000000W100000000", c95="ALPHA POINT"), fixed("EA", c13="BRAVO", c19="K1", c32="N41000000W100000000"), fixed("EA", c13="FARAW", c19="K1", c32="N60000000W100000000"),
            fixed("D ", c13="ALPHA", c19="K2", c32="N10000000W010000000"), fixed("P ", c6="KJFK", c12="A", c13="JFK", c32="N40383000W073463000", c93="KENNEDY"),
            fixed("ER", c13="J5", c25="0020", c29="BRAVO", c34="K1"), fixed("ER", c13="J5", c25="0010", c29="ALPHA", c34="K1"), fixed("ER", c13="J5", c25="0030", c29="FARAW", c34="K1"), fixed("ER", c13="J5", c25="0040", c29="NOPE", c34="K1"),
        ]
    )
    (tmp_path / "cifp").write_text(text)
    t = fixed_width.read(spark, str(tmp_path / "cifp"), "faa")
    assert rows(t.airports, "icao", "iata", "name", "country") == [("KJFK", "JFK", "KENNEDY", "US")]
    assert rows(t.points, "ident", "lat", "name") == [("ALPHA", 40.0, "ALPHA POINT"), ("BRAVO", 41.0, "BRAVO"), ("FARAW", 60.0, "FARAW")]
    assert rows(t.segments, "sequence", "distance_nm") == [(1, 60.04)]
    assert rows(t.issues, "code") == [("airway-discontinuity",), ("airway-point-missing",), ("record-short-line",)]
    assert rows(t.airways, "designator", "route_type") == [("J5", "JET")]


def test_piped(spark):
    lines = ["# c", "APT|ZZAA|AAA|First|400000N 1000000W|US", "FIX|ALPHA|A|400000N 1000000W|US|F", "NAVAID|BRV|B|410000N 1000000W|US|F", "AIRWAY|V1|2|BRV|US|F", "AIRWAY|V1|1|ALPHA|US|F", "AIRWAY|V1|3|NONE|US|F", "WHAT|x"]
    t = fixed_width.piped(spark.createDataFrame(list(enumerate(lines, 1)), "ord int, line string"), "fixture")
    assert rows(t.airports, "iata", "lat") == [("AAA", 40.0)] and rows(t.points, "ident", "point_type") == [("ALPHA", "FIX"), ("BRV", "NAVAID")]
    assert rows(t.segments, "sequence", "distance_nm") == [(1, 60.04)] and rows(t.issues, "code") == [("airway-point-missing",), ("unknown-record",)]


def test_navdata(spark, tmp_path):
    (tmp_path / "fix.dat").write_text("I\n600 Version - data cycle 2401, build 20240101\n\n 10.0 20.0 ABCDE\n 10.0 20.0 BADLA\n95.0 1.0 WRONG\n99\n")
    (tmp_path / "nav.dat").write_text("I\n810 Version\n3 11.0 20.0 0 11000 100 0 VVV VOR XX\n4 11.0 20.0 0 11000 100 0 ILS VOR XX\n99\n")
    (tmp_path / "awy.dat").write_text("I\n640 Version\nBADLA 10.0 20.0 VVV 11.0 20.0 1 18 450 J1\nABCDE 10.0 20.0 VVV 11.0 20.0 2 18 450 J2\nBADLA 10.0 20.0 UNKNO 11.0 20.0 2 18 450 J2\n99\n")
    d = str(tmp_path)
    assert rows(navdata.fixes(spark, d), "ident", "region", "airport") == [("ABCDE", "XX", "ENRT"), ("BADLA", "XX", "ENRT")]
    assert rows(navdata.navaids(spark, d), "ident", "kind") == [("VVV", "VOR")]
    a = navdata.airways_inline(spark, d)
    assert rows(a, "from_ident", "route", "base_ft", "top_ft") == [("BADLA", "J1", 1800, 45000), ("BADLA", "J2", 1800, 45000)]  # the header rule drops ABCDE's line
    assert navdata.airways_inline(spark, d, header_skip=False).count() == 3
    t = navdata.tables(spark, d)
    assert rows(t.segments, "sequence", "distance_nm", "upper_ft") == [(1, None, 45000.0)] and rows(t.airways, "designator") == [("J1",), ("J2",)]
    assert rows(navdata.header(spark, d + "/fix.dat").where("cycle <> 'unknown'"), "cycle", "build") == [("2401", "20240101")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "earth_awy.dat").write_text("I\n1101 Version\nBADLA ED 11 VVV EG 3 N 1 18 450 M1\nBADLA ED 11 VVV EG 3 N 1 18 450\n99\n")
    assert rows(navdata.airways_keyed(spark, d + "/k"), "designator", "from_region", "to_type", "level") == [("M1", "ED", 3, 1)]


def test_xml_features(spark, tmp_path):
    f = lambda name, pos: f"<aixm:DesignatedPoint><aixm:timeSlice><aixm:DesignatedPointTimeSlice><aixm:designator>{name}</aixm:designator><aixm:type>ICAO</aixm:type><aixm:location><aixm:Point><gml:pos>{pos}</gml:pos></aixm:Point></aixm:location></aixm:DesignatedPointTimeSlice></aixm:timeSlice></aixm:DesignatedPoint>"
    (tmp_path / "a.xml").write_text(f"<m xmlns:aixm='http://www.aixm.aero/schema/5.1' xmlns:gml='http://www.opengis.net/gml/3.2'>{f('abcde', '10.5 20.5')}{f('ABCDE', '1 2')}{f('', '1 2')}{f('NOPOS', '')}</m>")
    assert rows(features.read(spark, str(tmp_path)), "ident", "lat", "lon", "kind") == [("ABCDE", 10.5, 20.5, "ICAO")]


def test_journeys(spark):
    import json

    point = lambda i: {"id": f"p{i}", "timestamp": f"2026-07-10T02:0{i}:00Z", "latitude": 25.0 + i, "longitude": 121.0, "source": "gps"}
    route = lambda kind, n: {"kind": kind, "points": [point(i) for i in range(n)]}
    seg = {"id": "s", "rawRoute": route("raw", 3), "processedRoute": route("processed", 2), "derivedReplayRoute": route("derivedReplay", 2)}
    docs = [json.dumps(x) for x in ({"id": "j", "startTime": "2026-07-10T02:00:00Z", "segments": [seg], "events": [{"id": "e", "timestamp": "2026-07-10T02:00:00Z", "type": "t", "mediaIds": ["m"]}]}, {"id": "k", "segments": []}, {"id": "l", "segments": [{**seg, "derivedReplayRoute": route("derivedReplay", 1)}]})] + ["no json", None]
    t = journeys.tables(spark.createDataFrame([(d,) for d in docs], "json string"))
    assert rows(t.journeys, "journey", "n_segments") == [("j", 1)] and t.rejected.count() == 4
    assert t.points.groupBy("route").count().orderBy("route").collect() == [("derivedReplay", 2), ("processed", 2), ("raw", 3)]
    assert rows(t.events, "journey", "id", "media") == [("j", "e", ["m"])]
    recorded = spark.createDataFrame([("r", i, 1.0 + i) for i in range(4)] + [("one", 0, 1.0)], "recording string, ord int, lat double")
    done = journeys.complete(t.points, spark.createDataFrame([("j", "r")], "journey string, recording string"), recorded)
    assert done.groupBy("route").count().where("count = 4").count() == 3
    assert journeys.complete(t.points, spark.createDataFrame([("j", "one")], "journey string, recording string"), recorded).count() == 7


def test_union(spark):
    t = fixed_width.piped(spark.createDataFrame([(1, "FIX|A1|A|400000N 1000000W|US|F")], "ord int, line string"), "a")
    assert canonical.union(t, t).points.count() == 2
    assert io is not None


def test_features_of_several_roots(spark, tmp_path):
    """The first country and feature that names an ident gives its place; small files and other files don't count."""
    f = lambda kind, name, pos, point="Point": f"<aixm:{kind}><aixm:timeSlice><aixm:{kind}TimeSlice><aixm:designator>{name}</aixm:designator><aixm:location><aixm:{point}><gml:pos>{pos}</gml:pos></aixm:{point}></aixm:location></aixm:{kind}TimeSlice></aixm:timeSlice></aixm:{kind}>"
    pad = f"<!-- {'x' * 10_000} -->"
    for at, body in {"b/x/one.xml": f("DesignatedPoint", "AAA", "1 1") + f("DesignatedPoint", "BBB", "1 2") + pad, "b/two.xml": f("Navaid", "CCC", "2 1", "ElevatedPoint") + f("Navaid", "AAA", "2 2") + pad, "a/n.xml": f("Navaid", "BBB", "3 1") + f("Navaid", "AAA", "91") + pad, "a/small.xml": f("DesignatedPoint", "DDD", "4 1"), "a/other.txt": f("DesignatedPoint", "EEE", "4 1") + pad}.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(f"<m xmlns:aixm='http://www.aixm.aero/schema/5.1.1' xmlns:gml='http://www.opengis.net/gml/3.2'>{body}</m>")
    points, countries = features.merged(spark, {"b": f"{tmp_path}/b", "a": f"{tmp_path}/a"})
    assert rows(points, "ident", "lat", "lon", "country", "feature") == [("AAA", 1.0, 1.0, "b", "DesignatedPoint"), ("BBB", 3.0, 1.0, "a", "Navaid"), ("CCC", 2.0, 1.0, "b", "Navaid")]
    assert rows(countries, "country", "feature", "n") == [("a", "Navaid", 1), ("b", "DesignatedPoint", 2), ("b", "Navaid", 2)]
