"""PDF files of several makes, and publications that are told by the heads of their tables."""

import zlib

import pytest

from wayfare.sinks import pdf as sink
from wayfare.sources import build, header_tables, pdf


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def assembled(content: bytes, font: bytes, *more: bytes, packed: bool = False) -> bytes:
    """A one-page file without a cross-reference table; packed: its dictionaries in an object stream."""
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>", font]
    stream = b"5 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(content), content)
    extra = b"".join(b"%d 0 obj\n%s\nendobj\n" % (6 + i, m) for i, m in enumerate(more))
    if not packed:
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (n, x) for n, x in enumerate(body, 1)) + stream + extra
    at, head = 0, b""
    for n, x in enumerate(body, 1):
        head += b"%d %d " % (n, at)
        at += len(x) + 1
    inner = zlib.compress(head + b"\n".join(body))
    return b"%%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 4 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(inner), inner) + stream + extra


COURIER = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"


def test_text_state(spark):
    """Moves, matrices, spacing, leading, escapes, saved states and inline images."""
    content = rb"""q 2 0 0 2 100 100 cm BT /F1 10 Tf 1 0 0 1 20 300 Tm (Scaled) Tj ET Q
% a comment ( that is none
BT /F1 10 Tf 50 700 Td (a\(b\)\\ \101\
c) Tj 12 TL T* [(AB) -1000 (CD) 100 (E)] TJ 0 -24 TD (next) ' 5 2 (w o) " ET
BT /F1 10 Tf 100 Tz 2 Tc 50 500 Td <41 42 4> Tj ET
BI /W 2 /H 1 /CS /G /BPC 8 ID (( EI
BT /F1 10 Tf 50 400 Td (after) Tj ET"""
    for packed in (False, True):
        got = {r.text: r for r in pdf.spans(files(spark, assembled(content, COURIER, packed=packed))).collect()}
        assert set(got) == {"Scaled", "a(b)\\ Ac", "AB CDE", "next", "w o", "AB@", "after"}
        s = got["Scaled"]
        assert (s.x0, s.size, s.x1) == (140.0, 20.0, 140 + 6 * 12.0) and s.y1 == pytest.approx(800 - 700 + 4)
        assert got["a(b)\\ Ac"].x1 == pytest.approx(50 + 8 * 6)
        assert got["AB CDE"].y1 == pytest.approx(800 - 688 + 2) and got["AB CDE"].x1 == pytest.approx(50 + 30 + 10 - 1)
        assert got["next"].y1 == pytest.approx(800 - 640 + 2) and got["w o"].x1 == pytest.approx(50 + 18 + 5 + 6)
        assert got["AB@"].x1 == pytest.approx(50 + 18 + 6) and got["after"].page == 0


def test_fonts(spark):
    """Widths and differences of a simple font; a composite font with a map to Unicode."""
    simple = b"<< /Type /Font /Subtype /TrueType /BaseFont /X /FirstChar 65 /Widths [500 250] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /degree /uni00E9 /Z] >> >>"
    got = pdf.spans(files(spark, assembled(b"BT /F1 10 Tf 0 0 Td (ABC) Tj ET", simple))).first()
    assert (got.text, got.x1) == ("°éZ", pytest.approx(5 + 2.5 + 5))
    cmap = b"/CIDInit /ProcSet findresource begin 1 beginbfchar <0003> <00200041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00DF> <4E2D>] endbfrange end"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Y /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    more = b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [3 [200] 16 18 400] >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    got = pdf.spans(files(spark, assembled(b"BT /F1 10 Tf 0 0 Td <000300100012002000210099> Tj ET", font, *more))).first()
    assert (got.text, got.x1) == (" AacßZ中".replace("Z", ""), pytest.approx(2 + 4 + 4 + 10 + 10 + 10))


def test_blocks_and_texts(spark, tmp_path):
    page = [(40, 700, 10, "left"), (40, 688, 10, "below"), (40, 600, 10, "far"), (200, 700, 10, "right"), (226, 700, 10, "word"), (300, 700, 10, "cell")]
    (tmp_path / "a.pdf").write_bytes(sink.rendered([page, [(10, 10, 8, "second ä")]]))
    read = pdf.read(spark, f"file://{tmp_path}/*.pdf")
    assert sorted((r.page, r.text) for r in pdf.blocks(read).collect()) == [(0, "cell"), (0, "far"), (0, "left below"), (0, "rightword"), (1, "second ä")]
    assert pdf.texts(read).first().text == "left\nrightword\ncell\nbelow\nfar\nsecond ä"
    for bad in (b"", b"no pdf", sink.rendered([[]]), sink.rendered([])):
        with pytest.raises(Exception, match="PDF file"):
            pdf.spans(files(spark, bad)).count()


def test_amended_and_indirect(spark):
    """Of two objects with one number the last counts; lengths and contents may be references, contents several."""
    first = sink.rendered([[(10, 10, 8, "old")]])
    assert pdf.texts(files(spark, first + b"5 0 obj\n<< /Length 6 0 R >>\nstream\nBT /F1 8 Tf (new) Tj ET\nendstream\nendobj\n6 0 obj 23 endobj\n")).first().text == "new"


ROUTE = "<table><tr><td>▲</td><td>{0}</td></tr><tr><td></td><td>{1}</td></tr></table>"


def test_issues_and_order(spark):
    """What each kind of row says when it is wrong, and which of several points an ident means."""
    table = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    one, two, three = "250000N 1210000E", "260000N 1220000E", "270000N 1230000E"
    docs = [
        ("a", table(("Ident", "Coordinates"), ("AAA", one), ("AAA", two), ("", one), ("BBB", "nil"))),
        ("b", table(("Name-code designator", "Coordinates"), ("1", "2"), ("AAA", three), ("CCC", three), ("DDD", "x"), ("EEE", ""))),
        ("c", table(("HLDG", "Coordinates INBD"), (f"CCC {one}", ""), (f"△ {two}", ""), (f"HHH {three}", ""))),
        ("d", table(("Route designator", "Great circle"), (f"AAA {three}", ""), ("Direct route one-two", ""), (f"AAA {three}", ""), ("no place", ""), (f"NEW (x) {one}", ""), ("Direct Route short", ""), (f"CCC {one}", ""))),
        ("e", table(("Airway", "Sequence", "Ident", "Type"), ("T1", "20", "CCC", ""), ("T1", "10", "AAA", "J"), ("T1", "30", "ZZZ", ""), ("T1", "40", "NEW", ""), ("", "1", "AAA", ""), ("T1", "x", "AAA", ""))),
        ("route_q 1", ROUTE.format("ABC VOR 'NEW'", two) + ROUTE.format("CCC (c)", one) + ROUTE.format("NEW", one) + ROUTE.format("BAD", "nil") + ROUTE.format("(?)", one)),
        ("route_q2", ROUTE.format("CCC", one)),
        ("z", table(("Ident", "Coordinates"), ("ZZZ", one)) + table(("ICAO", "IATA", "Name", "Coordinates"), ("RCTP", "tpe", "Taipei", one), ("RCXX", "", "x", "nil"))),
    ]
    t = header_tables.tables(spark.createDataFrame(docs, "document string, html string"))
    points = sorted((r.ident, r.point_type, r.lat) for r in t.points.collect())
    assert points == [("AAA", "FIX", 25.0), ("AAA", "FIX", 26.0), ("AAA", "SIGNIFICANT_POINT", 27.0), ("CCC", "SIGNIFICANT_POINT", 27.0), ("HHH", "HOLDING_FIX", 27.0), ("NEW", "SIGNIFICANT_POINT", 25.0), ("ZZZ", "FIX", 25.0)]
    place = {r.uid: (r.ident, r.lat) for r in t.points.collect()}
    name = {r.uid: r.designator for r in t.airways.collect()}
    legs = sorted((name[r.airway_uid], r.sequence, place[r.from_uid], place[r.to_uid]) for r in t.segments.collect())
    assert legs == [
        ("DIRECT_ROUTE_ONE_TWO", 1, ("AAA", 26.0), ("NEW", 25.0)),
        ("Q 1", 1, ("NEW", 25.0), ("CCC", 27.0)),  # NEW comes twice
        ("T1", 1, ("AAA", 26.0), ("CCC", 27.0)),
    ]
    assert {(r.designator, r.route_type) for r in t.airways.collect()} == {("DIRECT_ROUTE_ONE_TWO", "DIRECT"), ("T1", "RNAV"), ("Q 1", "ENROUTE")}
    issues = {}
    for r in t.issues.collect():
        issues[r.code] = issues.get(r.code, 0) + 1
    assert issues == {"empty-ident": 1, "point-coordinate": 1, "taiwan-enr44-coordinate": 1, "taiwan-point-ident": 1, "route-row-empty": 2, "route-point-missing": 2, "taiwan-route-coordinate": 1, "taiwan-route-ident": 1, "taiwan-route-too-short": 1, "airport-coordinate": 1}
    assert [(r.icao, r.iata, r.country) for r in t.airports.collect()] == [("RCTP", "TPE", "TW")]
    nothing = header_tables.tables(spark.createDataFrame([("x", None), ("y", "<table></table>")], "document string, html string"))
    assert all(df.count() == 0 for df in nothing)


def test_built_from_configurations(spark, tmp_path):
    """A chart as a PDF file, one read by its blocks, and a publisher of headed tables."""
    (tmp_path / "c.pdf").write_bytes(sink.rendered([[(40, 700, 10, "M 100"), (90, 680, 10, "ALPHA"), (200, 680, 10, "10°00'00\"S 070°00'00\"W"), (90, 640, 10, "BRAVO"), (200, 640, 10, "11°00'00\"S 071°00'00\"W")]]))
    t = build.build(spark, {"source": "chile", "raw_files": {"enr_3": f"file://{tmp_path}/c.pdf"}})
    assert sorted(r.ident for r in t.points.collect()) == ["ALPHA", "BRAVO"] and t.segments.count() == 1
    (tmp_path / "m.pdf").write_bytes(sink.rendered([[(40, 700, 10, "A464"), (40, 680, 10, "ALPHA 010000N 1030000E"), (40, 640, 10, "BRAVO 020000N 1040000E")]]))
    t = build.build(spark, {"source": "malaysia", "raw_files": {"enr": f"file://{tmp_path}/m.pdf"}})
    assert sorted(r.ident for r in t.points.collect()) == ["ALPHA", "BRAVO"]
    (tmp_path / "R1.html").write_text(ROUTE.format("AAA", "250000N 1210000E") + ROUTE.format("BBB", "260000N 1220000E"))
    config = {"source": "taiwan", "raw_files": {}, "raw_route_dir": f"file://{tmp_path}", "official_route_documents": {"R1": "https://x.org/a%20b/R1.html"}}
    t = build.build(spark, config)
    assert [r.designator for r in t.airways.collect()] == ["R1"] and t.segments.count() == 1
