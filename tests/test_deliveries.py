"""Revisions that are swapped, packs that are refused, and a queue that is killed and started again."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.sinks import lifecycle, public_pack, versions
from wayfare.streaming import outbox


def ids(spark, root):
    at = versions.current(spark, root)
    return at and sorted(r[0] for r in spark.read.parquet(at).collect())


def test_revisions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.read_file(spark, f"{root}/{versions.POINTER}") is None
    first, taken = versions.stage(spark.range(3), root, "r1", measures={"n": F.count(F.lit(1)), "top": F.max("id")})
    assert taken == {"n": 3, "top": 2} and versions.current(spark, root) is None
    versions.swap(spark, root, first)
    held = spark.read.parquet(versions.current(spark, root))
    second, _ = versions.stage(spark.range(5), root, "r2")
    assert ids(spark, root) == [0, 1, 2]
    versions.swap(spark, root, second)
    assert ids(spark, root) == [0, 1, 2, 3, 4] and held.count() == 3
    with pytest.raises(FileNotFoundError):
        versions.swap(spark, root, "r3-not-there")
    with pytest.raises(Exception, match="breaks off"):
        versions.stage(spark.range(5).where(F.col("id") < F.raise_error(F.lit("breaks off")).cast("long")), root, "r3")
    with pytest.raises(versions.Refused) as refused:
        versions.stage(spark.range(10), root, "r4", {"even": F.col("id") % 2 == 0, "small": F.when(F.col("id") < 9, True)})
    assert refused.value.rows == {"even": 5, "small": 1}
    (tmp_path / "t" / "r5-half").mkdir()
    assert versions.sweep(spark, root, keep=1) == ["r5-half"] and held.count() == 3
    assert versions.sweep(spark, root, keep=0) == [first] and ids(spark, root) == [0, 1, 2, 3, 4]
    assert versions.refresh(spark, root, "r6", lambda: spark.range(1), "current") == versions.current(spark, root) and len(ids(spark, root)) == 5
    versions.refresh(spark, root, "r6", lambda: spark.range(0), "staged")
    assert ids(spark, root) == []


def test_small_files_replace_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.txt"
    for text in ("first é\n", "", "third"):
        versions.write_file(spark, path, text)
        assert versions.read_file(spark, path) == text
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b.txt"]


ABOUT = public_pack.About("p", "1", "nav", "public", "GPL-2.0-or-later", "GNU GPL 2", "nav data", notices={"NOTICE.txt": "n\n"})


def lines(spark, *more):
    rows = [("points", 0, '["A",1.0,2.0,"FIX","nav"]'), ("points", 1, '["B",1.0,3.0,"FIX","nav"]'), ("airways", 0, '["W1","ATS","nav"]'), ("segments", 0, '[0,1,0,60.0,""]'), *more]
    return spark.createDataFrame(rows, "part string, idx long, json string")


def test_public_pack(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    manifest = public_pack.publish(lines(spark), root, ABOUT, "2024-01-01T00:00:00Z")
    at = versions.current(spark, root)
    paper = lambda n: versions.read_file(spark, f"{at}/{n}")
    assert json.loads(paper(public_pack.MANIFEST)) == manifest
    assert manifest["regions"] == [{"id": "global", "countries": ["GLOBAL"], "airports": 0, "points": 2, "airways": 1, "segments": 1}]
    for kind in ("reports", "notices"):
        for e in manifest["payloads"][kind]:
            assert (len(paper(e["path"]).encode()), public_pack.packs.sha256_hex(paper(e["path"]))) == (e["bytes"], e["sha256"])
    assert json.loads(paper(public_pack.VALIDATION))["checks"]["onlySourcePoints"] is True
    again = public_pack.publish(lines(spark).repartition(3), f"{root}2", ABOUT, "2024-01-01T00:00:00Z")
    assert again == manifest  # equal packs have equal papers
    bad = {
        "onlySourcePoints": ("points", 2, '["C",1.0,2.0,"FIX","other"]'),
        "onlySourceAirways": ("airways", 1, '["W2","ATS"]'),
        "segmentShape": ("segments", 1, "[0,1]"),
        "noMixedAirportRows": ("airports", 0, '["KA","AAA","a",1.0,2.0,"US"]'),
    }
    for name, row in bad.items():
        with pytest.raises(versions.Refused) as refused:
            public_pack.publish(lines(spark, row), root, ABOUT, "2024-01-02T00:00:00Z")
        assert refused.value.rows == {name: 1} and versions.current(spark, root) == at
    with pytest.raises(versions.Refused):
        public_pack.publish(lines(spark), root, ABOUT, "2024-01-02T00:00:00Z", region="asia")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == [at.rsplit("/", 1)[1]]


SCHEMA = "session string, id long, kind string, payload string, ts timestamp"


def feed(spark, path, *batches):
    for i, rows in enumerate(batches):
        at = [(s, k, kind, f"p{k}", datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=t)) for s, k, kind, t in rows]
        spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")


def run(spark, path, sink, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    q = outbox.attempts(stream, delay="0 seconds").writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def test_killed_and_started_again(spark, tmp_path):
    """A stream that dies while a batch is being delivered sends everything after its restart, and each message is read once."""
    path = f"file://{tmp_path}"
    feed(
        spark, f"{path}/in",
        [("a", 1, "message", 0), ("a", 2, "message", 5), ("b", 7, "message", 3), (None, 9, "message", 3)],
        [("a", 1, "ack", 50), ("a", 3, "message", 100), ("b", 7, "message", 101)],
        [("a", 2, "ack", 130), ("b", 8, "message", 200), ("b", 7, "ack", 205)],
        [("c", 4, "message", 4000)],
    )
    calls = []

    def failing(batch, number):
        calls.append(number)
        outbox.ledger(f"{path}/ledger")(batch, number)
        if len(calls) == 3:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, path, failing, "one")
    run(spark, path, outbox.ledger(f"{path}/ledger"), "one")
    run(spark, path, outbox.ledger(f"{path}/whole"), "two")
    columns = ["session", "id", "attempt", "status", "at_us"]
    rows = lambda at: sorted(map(tuple, outbox.ledger_rows(spark, f"{path}/{at}").select(*columns).collect()))
    assert rows("ledger") == rows("whole")
    base = 1_704_067_200
    seen = [(s, i, n, st, us // 1_000_000 - base) for s, i, n, st, us in rows("ledger")]
    assert [x for x in seen if x[1] == 1] == [("a", 1, 1, "sent", 0)]  # acknowledged in time
    assert [x for x in seen if x[1] == 2] == [("a", 2, 1, "sent", 5), ("a", 2, 2, "sent", 65)]
    assert [x for x in seen if x[1] == 7] == [("b", 7, 1, "sent", 3), ("b", 7, 2, "sent", 63), ("b", 7, 3, "sent", 183)]  # not queued twice
    assert [x[2:] for x in seen if x[1] == 8] == [(1, "sent", 200), (2, "sent", 260), (3, "sent", 380), (4, "sent", 620), (5, "sent", 1100), (6, "dead", 2060)]  # by timers alone
    got = outbox.delivered(spark, f"{path}/ledger").collect()
    assert sorted((r.session, r.id, r.tries) for r in got) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 5), ("b", 7, 3), ("b", 8, 5), ("c", 4, 1)]
    assert all(r.payload == f"p{r.id}" for r in got)
    assert outbox.ledger_rows(spark, f"{path}/none").count() == 0


def test_lifecycle(spark, tmp_path):
    """Old rows are read in the new shape, and rows go with all that refers to them, children first."""
    path = f"file://{tmp_path}/t"
    added = [lifecycle.Added(2, "b", "int", F.col("a") * 10), lifecycle.Added(3, "c", "string")]
    assert lifecycle.read(spark, path, "a int", added).collect() == []
    lifecycle.append(spark.createDataFrame([(1,)], "a int"), path, 1)
    lifecycle.append(spark.createDataFrame([(3, None, "x")], "a int, b int, c string"), path, 3)
    lifecycle.append(spark.createDataFrame([(2,)], "a int"), path, 1)
    assert sorted(map(tuple, lifecycle.read(spark, path, "a int", added).collect())) == [(1, 10, None), (2, 20, None), (3, None, "x")]
    tables = {
        "journey": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "segment": spark.createDataFrame([(10, 1), (20, 2), (30, None), (20, 2)], "id int, journey int"),
        "point": spark.createDataFrame([("p", 10), ("q", 20), ("r", None)], "name string, segment int"),
        "photo": spark.createDataFrame([(7, 1, 20), (8, 3, 20), (9, 3, None)], "id int, journey int, segment int"),
        "source": spark.createDataFrame([(0,)], "id int"),
    }
    refs = [lifecycle.Reference("segment", "journey", "journey", "id"), lifecycle.Reference("point", "segment", "segment", "id"), lifecycle.Reference("photo", "journey", "journey", "id"), lifecycle.Reference("photo", "segment", "segment", "id")]
    steps = [(n, sorted(map(str, map(tuple, df.collect())))) for n, df in lifecycle.cascade(tables, refs, "journey", F.col("id") == 2)]
    assert [n for n, _ in steps][-2:] == ["segment", "journey"] and {n for n, _ in steps[:2]} == {"point", "photo"}
    assert dict(steps) == {"point": ["('p', 10)", "('r', None)"], "photo": ["(7, 1, 20)", "(8, 3, 20)", "(9, 3, None)"][2:], "segment": ["(10, 1)", "(30, None)"], "journey": ["(1,)", "(3,)"]}
    held = dict(tables)
    for name, rows in lifecycle.cascade(tables, refs, "journey", F.lit(True)):
        held[name] = rows
        for r in refs:
            parents = [x[0] for x in held[r.parent].select(r.key).collect()]
            assert all(x[0] in parents for x in held[r.child].where(F.col(r.column).isNotNull()).select(r.column).collect())
    assert held["journey"].count() == 0
    with pytest.raises(ValueError):
        lifecycle.deletion_order(["a", "b"], [lifecycle.Reference("a", "x", "b", "id"), lifecycle.Reference("b", "x", "a", "id")])
