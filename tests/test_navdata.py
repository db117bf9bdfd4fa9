"""Lines of navigation data are split once, however many conditions ask for their parts."""

from wayfare.sources import navdata


def test_lines_are_split_once(spark, tmp_path, capsys):
    (tmp_path / "a_awy.txt").write_text("I\n640 Version\nBBB 1.00  2.00 CCC 3.00 4.00 1 10 450 W1\n99\n\n CCC 3.00 4.00 BBB 1.00 2.00 x 10 450 W1\n")
    df = navdata.airways_inline(spark, str(tmp_path), "*.txt")
    assert [(r.from_ident, r.from_lat, r.to_ident, r.base_ft, r.route) for r in df.collect()] == [("BBB", 1.0, "CCC", 1000, "W1")]
    df.explain()
    assert capsys.readouterr().out.count("split(") <= 2
