"""What a year's journeys are listed as."""

from wayfare import catalog

SF = "/root/testdata/sf0.001"


def test_a_year_is_one_row(spark):
    years = catalog.QUERIES["time_machine"](spark, SF)
    assert years.columns == ["year", "journeys", "ids", "length_m"]
    rows = {r.year: r for r in years.collect()}
    assert len(rows) == years.count()
    every = {}
    for r in catalog.QUERIES["journey_summary"](spark, SF).collect():
        every.setdefault(r.year, []).append(r.journey)
    assert {y: r.ids for y, r in rows.items()} == {y: ",".join(map(str, sorted(j))) for y, j in every.items()}
