"""A pack that is given away: declared assertions and coverage taken in the pass that writes it, then its papers.

The lines of a pack are staged as gzipped files; while they are written, every assertion counts the rows
that break it and every measure counts its part. A pack that breaks one is refused before anything
points to it. A good one gets its manifest, coverage and validation reports and notices, and is swapped in.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packs, versions

#: Names of a pack's files.
MANIFEST, COVERAGE, VALIDATION = "aviation-pack-manifest.json", "coverage_report.json", "validation_report.json"
REGION = "global"


@dataclass(frozen=True)
class About:
    """What a public pack says about itself and its one source."""

    pack: str
    version: str
    source: str
    mode: str
    licence: str
    licence_name: str
    provider: str
    cycle: str = ""
    url: str = ""
    notices: dict[str, str] = field(default_factory=dict)  # file name: text


def assertions(source: str) -> dict[str, Column]:
    """The conditions of each line: points and airways of the one source, every line of its part's shape, and no airports."""
    part, fields = F.col("part"), F.from_json("json", "array<string>")
    of = lambda name, at: F.when(part == name, (F.size(fields) > at) & (F.try_element_at(fields, F.lit(at + 1)) == source)).otherwise(True)
    shape = F.when(part == "segments", F.size(fields) == packs.SHAPES["segments"]).otherwise(True)
    return {"onlySourcePoints": of("points", 4), "onlySourceAirways": of("airways", 2), "segmentShape": shape, "noMixedAirportRows": part != "airports"}


def measures() -> dict[str, Column]:
    """Rows and bytes of each part."""
    found = {p: F.count_if(F.col("part") == p) for p in packs.SHAPES}
    return found | {f"{p} bytes": F.coalesce(F.sum(F.when(F.col("part") == p, F.octet_length("json") + 1)), F.lit(0)) for p in packs.SHAPES}


def _write(lines: DataFrame, path: str) -> None:
    lines.select("part", F.col("json").alias("value")).write.partitionBy("part").option("compression", "gzip").text(path)


def _in_order(lines: DataFrame) -> DataFrame:
    return lines.repartitionByRange("part", "idx").sortWithinPartitions("part", "idx")


def publish(lines: DataFrame, root: str, about: About, generated_at: str, region: str = REGION) -> dict:
    """Stage, check and swap in a pack of pack_rows lines (part, idx, json); returns its manifest.

    lines are read twice (the files and their digests), so they should be a written table. Raises
    versions.Refused with the count of rows that break each assertion; then the former pack stays.
    """
    spark = lines.sparkSession
    if region != REGION:
        raise versions.Refused({"globalRegion": 1})
    name, got = versions.stage(_in_order(lines), root, about.version, assertions(about.source), measures(), _write)
    path = f"{root}/{name}"
    digests = {r.part: r.sha256 for r in packs.part_digests(lines).collect()}  # a row for each part
    counts = {p: got[p] for p in ("airports", "points", "airways", "segments")}
    licence = {"spdx": about.licence, "name": about.licence_name, "noticePaths": sorted(about.notices), "source": about.provider, "sourceUrl": about.url}
    coverage = {"generated_at": generated_at, "sourceMode": about.mode, "license": licence, "regions": {region: {"countries": [region.upper()], **counts}}, "known_points": {}, "validation": {"errors": 0, "warnings": 0}}
    checks = {**dict.fromkeys(assertions(about.source), True), "globalRegion": True, "points": counts["points"], "airways": counts["airways"], "segments": counts["segments"]}
    validation = {"generatedAt": generated_at, "sourceMode": about.mode, "checks": checks, "issues": []}
    papers = {COVERAGE: coverage, VALIDATION: validation}
    texts = {n: json.dumps(p, indent=2, ensure_ascii=False) + "\n" for n, p in papers.items()} | about.notices
    entry = lambda at, kind, size, digest: {"path": at, "bytes": size, "sha256": digest, "contentType": kind, "public": True}
    of_text = lambda n, kind: entry(n, kind, len(texts[n].encode()), packs.sha256_hex(texts[n]))
    payloads = {
        "airgraph": [entry(f"part={p}", "application/json+gzip", got[f"{p} bytes"], digests[p]) for p in sorted(digests)],
        "notices": [of_text(n, "text/plain") for n in sorted(about.notices)],
        "reports": [of_text(n, "application/json") for n in sorted(papers)],
    }
    whole = packs.sha256_hex("".join(digests[p] for p in sorted(digests)))
    source = {"sourceId": about.source, "provider": about.provider, "country": None, "redistributionStatus": "redistribution_allowed", "airacCycle": about.cycle, "license": about.licence, "sourceUrl": about.url}
    manifest = {"id": about.pack, "version": about.version, "generatedAt": generated_at, "generatedFrom": f"sha256:{whole}", "sourceMode": about.mode, "license": licence, "regions": [{"id": region, "countries": [region.upper()], **counts}], "sources": [source], "payloads": payloads}
    texts[MANIFEST] = json.dumps(manifest, indent=2, ensure_ascii=False) + "\n"
    for file, text in texts.items():
        versions.write_file(spark, f"{path}/{file}", text)
    versions.swap(spark, root, name)
    return manifest
