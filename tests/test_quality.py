from compare import connect, differences
from wayfare import catalog
from wayfare.operators import quality


def test_joins_take_all_partitions(spark):
    """However small its files, no table is broadcast, and every shuffle partition sorts its share."""
    points = spark.createDataFrame([(i, f"P{i}", float(i % 90), float(i % 180)) for i in range(300)], "uid long, ident string, lat double, lon double")
    airways = spark.createDataFrame([(1, "A1"), (2, "A2")], "uid long, designator string")
    segments = spark.createDataFrame([(f"1-{i}", 1, i, i + 1) for i in range(299)] + [("1-x", 1, 5, -1)], "uid string, airway_uid long, from_uid long, to_uid long")
    found = quality.issues(points, airways, segments)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan and "REPARTITION_BY_NUM" in plan
    got = {(r.code, r.entity) for r in found.collect() if r.severity == "error"}
    assert got == {("airway-no-segments", "2"), ("segment-missing-point", "1-x")}


def test_counts_join_in_all_partitions(spark):
    """The counted issues come from the same joins."""
    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES["quality_severity_counts"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(any(f"hashpartitioning({k}#" in line and "REPARTITION_BY_NUM" in line for line in plan.split("\n")) for k in ("from_uid", "to_uid"))
    assert differences(found, connect(sf), catalog.ORACLE_SQL["quality_severity_counts"]) == []
