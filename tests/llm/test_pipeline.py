"""The pipeline against its stages applied in memory, and what must hold from stage to stage."""

import brute
import corpus_pipeline as P
from wayfare.llm import line_dedup, mixing, quality_rules

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    tables = [docs]
    for name, stage in P.STAGES:
        out = str(tmp_path / name)
        stage(spark, tables[-1], D).write.parquet(out)
        tables.append(spark.read.parquet(out))
    good, lines, single, mixed, coded = tables[1:]
    assert all(t.columns == docs.columns for t in (good, lines, single, mixed))

    kept = {r.doc_id for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    rows = good.collect()
    texts = brute.boilerplate([(r.source, r.text) for r in rows], 0.1, 2)
    cleaned = {r.doc_id: t for r, t in zip(rows, texts, strict=True)}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in cleaned.items()}

    # exact copies collapse to the smallest id, similar ones (0.8 of shingles) share a survivor, unlike ones stay
    left = {r.doc_id for r in single.collect()}
    sets = {i: brute.shingles(t) for i, t in cleaned.items()}
    alike = lambda a, b: bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or not (sets[a] or sets[b])
    group = brute.classes(cleaned, alike)
    assert left == set(group.values())
    for i in set(cleaned) - left:
        assert any(alike(i, j) for j in cleaned if j != i)
    assert not [(a, b) for a in left for b in left if b < a and alike(a, b)]

    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(single).collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: n for i, n in taken.items() if n}

    assert coded.count() == mixed.count() and coded.where("NOT round_trip OR n_pieces <> size(ids)").count() == 0
    assert sorted(tuple(r) for r in P.run(spark, D).select("doc_id", "n_pieces").collect()) == sorted(tuple(r) for r in coded.select("doc_id", "n_pieces").collect())


def test_hard_rows_and_empty_table(spark, hard, empty, tmp_path):
    for docs in (hard, empty):
        for name, stage in P.STAGES:
            out = str(tmp_path / f"{name}-{docs is empty}")
            stage(spark, docs, D).write.parquet(out)
            assert line_dedup is not None and spark.read.parquet(out).columns


def test_registry(spark):
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
