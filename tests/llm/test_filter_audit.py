import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

import brute
from compare import connect, differences
from wayfare.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"


def plain(rows, labels):
    """Each document run through each order, one by one."""
    good, toxic = {r.doc_id for r in labels if r.quality == 1} - {None}, {r.doc_id for r in labels if r.toxic == 1} - {None}
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    out, lost = Counter(), Counter()
    parts = {r.lang or "" for r in rows}
    for r in rows:
        t, words, part = r.text or "", brute.words(r.text), r.lang or ""
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > least[t]}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                at = (part, "".join(order), step)
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[at, "redundant"] += fails[f] and gone
                if fails[f] and not gone:
                    gone = True
                    out[at, "removed"] += 1
                    out[at, "good_lost"] += r.doc_id in good
                    out[at, "toxic_lost"] += r.doc_id in toxic
                    lost[part, f] += 1
                out[at, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, "".join(o), s, *(int(out[(p, "".join(o), s), n]) for n in names), lost[p, o[s - 1]]) for p in parts for o in itertools.permutations("ABCDE") for s in range(1, 6))


def got(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).collect()))


def test_equals_plain(spark, documents, labels, hard):
    assert got(documents, labels) == plain(documents.collect(), labels.collect())
    again = hard.withColumn("lang", F.when(F.col("doc_id") > 5, F.col("lang")))  # copies in two parts
    more = again.unionByName(again.withColumn("doc_id", F.col("doc_id") - 7)).unionByName(again.where("doc_id > 9"))
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, 1), (None, 1, 1), (11, 1, None), (999, 1, 1), (-2, 1, 1)], "doc_id long, quality int, toxic int")
    assert got(more, marks) == plain(more.collect(), marks.collect())


def test_empty(empty, labels, hard, spark):
    assert got(empty, labels) == []
    assert len(got(hard, labels.limit(0))) == 600 * len({r.lang for r in hard.collect()})


def test_equals_sql(spark):
    assert differences(queries.op11_filter_audit(spark, SF), connect(SF), queries.ORACLE_SQL["op11_filter_audit"]) == []
