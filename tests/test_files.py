"""Scans of changed files, and what rebuilds leave behind."""

import json
import os
import time

from pyspark.sql import functions as F

from meterline import adapters
from meterline.functions.storage import children, delete, freeze, recorded, scratch_path
from meterline.plans.rollup import publish_rollups
from meterline.queries import QUERIES
from meterline.sources import session_logs as logs
from meterline.sources import sinks
from meterline.sources.upserts import file_report


def write(root, name, lines, at):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"n": n}) + "\n" for n in range(lines)))
    os.utime(path, (at, at))


def figures(scan):
    rows = {r.path.rsplit("/", 1)[-1] for r in scan.lines.collect()}
    by_frames = file_report(scan.files, scan.changed, scan.lines).first().asDict()
    report = scan.report()
    assert report == by_frames
    return rows, report


def test_a_second_scan_reads_changed_files_only(spark, tmp_path):
    active, archived = tmp_path / "active", tmp_path / "archived"
    write(active, "a.jsonl", 3, 1_786_000_000)
    write(active, "deep/b.jsonl", 2, 1_786_000_100)
    write(archived, "c.jsonl", 4, 1_785_000_000)
    write(active, "notes.txt", 9, 1_786_000_000)
    first = logs.scan_changed(spark, str(active), str(archived))
    assert figures(first) == ({"a.jsonl", "b.jsonl", "c.jsonl"}, {"files_scanned": 3, "files_changed": 3, "complete_lines": 9})
    known = spark.createDataFrame(first.files.collect(), first.files.schema)
    assert figures(logs.scan_changed(spark, str(active), str(archived), known)) == (
        set(), {"files_scanned": 3, "files_changed": 0, "complete_lines": 0})
    write(active, "a.jsonl", 5, 1_786_000_050)  # longer and later, but earlier than an unchanged file
    write(active, "d.jsonl", 1, 1_786_000_200)
    write(archived, "c.jsonl", 4, 1_785_000_001)  # the same size, another time
    assert figures(logs.scan_changed(spark, str(active), str(archived), known)) == (
        {"a.jsonl", "c.jsonl", "d.jsonl"}, {"files_scanned": 4, "files_changed": 3, "complete_lines": 10})


def test_missing_folders_and_empty_files(spark, tmp_path):
    (tmp_path / "active").mkdir()
    (tmp_path / "active" / "empty.jsonl").write_text("")
    scan = logs.scan_changed(spark, str(tmp_path / "active"), str(tmp_path / "none"))
    assert figures(scan) == (set(), {"files_scanned": 0, "files_changed": 0, "complete_lines": 0})
    nothing = logs.scan_changed(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert figures(nothing) == (set(), {"files_scanned": 0, "files_changed": 0, "complete_lines": 0})


def test_rebuilds_leave_one_version_and_no_scratch(spark, sf_dir, tmp_path):
    root = str(tmp_path / "usage")
    inputs = adapters.rollup_inputs(spark, sf_dir)
    folder = scratch_path(spark, "x").rsplit("/", 1)[0]
    before = children(spark, folder)
    first = publish_rollups(inputs, root, keep=1)
    rows = sinks.read_rollups(spark, root)["usage_daily"].collect()
    second = publish_rollups(inputs, root, keep=1)
    assert children(spark, folder) == before
    assert children(spark, f"{root}/versions") == [second] != [first]
    assert sinks.read_rollups(spark, root)["usage_daily"].collect() == rows and rows
    # A version in writing is left alone; one that died long ago goes.
    for name, at in (("running", None), ("dead", 1_700_000_000)):
        os.makedirs(f"{root}/versions/{name}")
        if at:
            os.utime(f"{root}/versions/{name}", (at, at))
    assert sinks.retain(spark, root, 1) == ["dead"]
    assert children(spark, f"{root}/versions") == sorted(["running", second])


def test_two_versions_stay_by_default(spark, tmp_path):
    from meterline.schemas import CHECKS

    assert "usage_daily" in CHECKS
    table = spark.createDataFrame([("2026-08-01", "settled")], "local_date string, account_token_freshness string")
    versions = [sinks.replace_rollups({"usage_daily": table.withColumn("n", F.lit(k))}, str(tmp_path)) for k in range(4)]
    assert children(spark, f"{tmp_path}/versions") == sorted(versions[2:])
    assert sinks.read_rollups(spark, str(tmp_path))["usage_daily"].first().n == 3


def test_a_frozen_table_leaves_no_shuffle_files(spark):
    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = shuffled()
    rows = spark.range(4_000).repartition(5, "id").groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s"))
    frozen = freeze(rows, "shuffled")
    until = time.time() + 20
    while (left := {f for f in shuffled() - before if f.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert frozen.agg(F.sum("s")).first()[0] == 4_000 * 3_999 // 2


def test_report_document_leaves_only_what_it_returns(spark, sf_dir):
    with recorded() as left:
        rows = QUERIES["report_document"](spark, sf_dir).collect()
    for path in left:
        delete(spark, path)
    assert len({r["section"] for r in rows}) == len(rows) > 10
    assert all(os.path.basename(path).startswith("section-") for path in left) and len(left) >= len(rows)
