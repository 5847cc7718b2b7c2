"""Files, stored lists and their edits, stored days, against plain loops."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import edits, files, shared
from quillspark.sources.tables import published
from quillspark.streaming.daily import merge_batch, merge_stream, stored_days

RECORD = "id string, owner long, at long, memo string, stamp string"


def records(n, seed=1):
    rng = random.Random(seed)
    return [(f"r{k}", rng.randint(0, 6), rng.randint(0, 50), rng.choice(["", "a", None]), "") for k in range(n)]


def listed(spark, path):
    return {tuple(r) for r in edits.read_list(spark, path, RECORD).collect()}


def test_edits_are_written_back(spark, tmp_path):
    path, rows = str(tmp_path / "list"), records(60)
    schema = spark.createDataFrame(rows, RECORD).schema
    assert listed(spark, path) == set()
    assert edits.insert_if_absent(path, spark.createDataFrame(rows[:40], RECORD), "id", 8) == 8
    changed = [(*r[:3], "other", "x") for r in rows[30:60]]
    edits.insert_if_absent(path, spark.createDataFrame(changed, RECORD), "id", 8)
    assert listed(spark, path) == {*rows[:40], *changed[10:]}
    changes = spark.createDataFrame([("r3", "new"), ("r50", None), ("absent", "x")], "id string, memo string")
    edits.upsert(path, changes, "id", schema, "stamp", F.lit("now"), 8)
    by_id = {r[0]: r for r in listed(spark, path)}
    assert by_id["r3"][3:] == ("new", "now") and by_id["r50"][3:] == (None, "now") and "absent" not in by_id and len(by_id) == 60
    edits.remove(path, changes, "id", schema, 8)
    assert {r[0] for r in listed(spark, path)} == {f"r{k}" for k in range(60)} - {"r3", "r50"}
    edits.remove(path, spark.createDataFrame(rows, RECORD), "id", schema, 8)  # buckets without rows go
    assert listed(spark, path) == set()
    assert edits.remove(path, spark.createDataFrame([], RECORD), "id", schema, 8) == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, rows = tmp_path / "list", records(200)
    edits.write_list(spark.createDataFrame(rows, RECORD), str(path), "id", 16)
    before = {p.parent.name: p.name for p in path.rglob("*.parquet")}
    assert edits.remove(str(path), spark.createDataFrame(rows[:1], RECORD), "id", spark.createDataFrame(rows, RECORD).schema, 16) == 1
    after = {p.parent.name: p.name for p in path.rglob("*.parquet")}
    assert len(before) == 16 and sum(after[b] != before[b] for b in before) == 1


def test_an_edit_that_fails_leaves_the_list(spark, tmp_path):
    path, rows = str(tmp_path / "list"), records(50)
    edits.write_list(spark.createDataFrame(rows, RECORD), path, "id", 8)
    bad = F.raise_error(F.lit("lost")).cast("string")
    with pytest.raises(Exception, match="lost"):
        edits.edit(path, spark.createDataFrame(rows, RECORD).schema, "id", spark.createDataFrame(rows, RECORD), lambda old: old.withColumn("memo", bad), 8)
    assert listed(spark, path) == set(rows)


def test_capped_lists(spark, tmp_path):
    path, rows, want = str(tmp_path / "list"), records(120), set()
    for part in (rows[:50], rows[50:90], rows[50:90], rows[90:]):
        edits.append_capped(path, spark.createDataFrame(part, RECORD), "owner", [F.desc("at"), F.col("id")], 5, 4)
        owners = {r[1] for r in {*want, *part}}
        want = {r for o in owners for r in sorted((r for r in {*want, *part} if r[1] == o), key=lambda r: (-r[2], r[0]))[:5]}
        assert listed(spark, path) == want


def test_blobs_that_do_not_fit_are_kept_aside(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": "no number"}', "no json", '{"b": "y"}', ""]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "one.json").write_text("\n".join(lines))
    good, bad = edits.read_blobs(spark, str(tmp_path / "blobs"), "a long, b string")
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (None, "y")}
    assert {r.line for r in bad.collect()} == {'{"a": "no number"}', "no json"}


ANSWERS = "ts timestamp, correct boolean, level string"


def answers(n, seed):
    rng = random.Random(seed)
    return [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 130)), rng.random() < 0.5, rng.choice(["sure", "unsure", "guess"])) for _ in range(n)]


def daily(rows):
    out = {}
    for ts, correct, level in rows:
        day = out.setdefault(ts.date(), [0, 0, {}])
        day[0] += 1
        day[1] += correct
        day[2][level] = day[2].get(level, 0) + 1
    return {d: (s, c, m) for d, (s, c, m) in out.items()}


def held(spark, path):
    return {r.day: (r.solved, r.correct, r.confidence) for r in stored_days(spark, path).collect()}


def test_a_batch_that_comes_again_counts_once(spark, tmp_path, monkeypatch):
    path, parts = str(tmp_path / "days"), [answers(40, k) for k in range(4)]
    for batch, part in enumerate(parts):
        rows = spark.createDataFrame(part, ANSWERS)
        if batch == 2:  # its first half of days is written, then the driver is lost
            some = sorted({t.date() for t, _, _ in part})[:3]
            merge_batch(path, rows.filter(F.to_date("ts").isin(some)), batch)
        merge_batch(path, rows, batch)
        merge_batch(path, rows, batch)
        assert held(spark, path) == daily([r for p in parts[: batch + 1] for r in p])
    merge_batch(path, spark.createDataFrame([], ANSWERS), 9)


def test_the_stream_goes_on_after_a_stop(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "days", "checkpoint"))
    every = []
    for k in range(3):
        every += answers(30, 10 + k)
        spark.createDataFrame(every[-30:], ANSWERS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", 1).parquet(source)
        merge_stream(stream, path, checkpoint).awaitTermination()
        assert held(spark, path) == daily(every)
    merge_stream(spark.readStream.schema(ANSWERS).parquet(source), path, checkpoint).awaitTermination()
    assert held(spark, path) == daily(every)


def test_files_and_views(spark, tmp_path):
    rows = spark.createDataFrame([("a", "한글 \"x\"", None), ("b", None, "draft"), ("c", "t", "published")], "id string, text string, status string")
    files.write_lines(rows, str(tmp_path / "lines"))
    said = [json.loads(line) for f in (tmp_path / "lines").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(said, key=lambda r: r["id"]) == [r.asDict() for r in rows.orderBy("id").collect()]
    assert "한글" in "".join(f.read_text() for f in (tmp_path / "lines").glob("*.json"))
    assert [r.id for r in published(spark, rows, name="v").collect()] == ["c"] == [r.id for r in spark.table("v").collect()]
    (tmp_path / "seed.json").write_text('[\n {"case_number": "1", "holding_summary_text": "x"},\n {"case_number": "2"}\n]')
    seed = files.read_seed(spark, str(tmp_path / "seed.json"), "case_number string, holding_summary_text string")
    assert seed.columns == ["caseNumber", "holdingSummaryText"] and {tuple(r) for r in seed.collect()} == {("1", "x"), ("2", None)}
    assert files.read_seed(spark, str(tmp_path / "none.json"), "case_number string").count() == 0
    (tmp_path / "m.csv").write_text(files.MANIFEST.replace(" string", "").replace(", ", ",") + '\nc1,high,,"2024도1","a, ""b""",,,,,,,,,\n')
    row = files.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (row.collection_id, row.subject, row.case_number, row.case_name, row.note) == ("c1", None, "2024도1", 'a, "b"', None)
    folder = shared.new_folder(spark)
    assert not shared.exists(spark, folder)
    rows.write.parquet(folder)
    assert shared.exists(spark, folder) and shared.size_bytes(spark, folder) > 0 and shared.state_of(spark, folder)
    shared.delete(spark, folder)
    assert not shared.exists(spark, folder)


def test_stages(spark, tmp_path):
    from quillspark.sources import stages

    path = str(tmp_path / "stages")
    items = spark.createDataFrame([(k, f"n{k}") for k in range(6)], "id long, name string")
    stages.collect_items(items, path)
    at = lambda: {r.id: (r.stage, r.reason) for r in stages.read_items(spark, path, items.schema).collect()}
    move = lambda *rows: {tuple(r) for r in stages.move_items(path, items.schema, "id", spark.createDataFrame(rows, "id long, to string, reason string")).collect()}
    assert at() == {k: ("raw", None) for k in range(6)}
    assert move((0, "normalized", ""), (1, "reviewed", ""), (2, "failed", " "), (3, "failed", "E2"), (9, "normalized", "")) == {(1, "raw", "reviewed"), (2, "raw", "failed")}
    assert at() == {0: ("normalized", None), 1: ("raw", None), 2: ("raw", None), 3: ("failed", "E2"), 4: ("raw", None), 5: ("raw", None)}
    assert move((0, "reviewed", ""), (3, "raw", "")) == set()
    assert at()[0] == ("reviewed", None) and at()[3] == ("raw", None)
    assert not (tmp_path / "stages" / "stage=failed").exists() and not (tmp_path / "stages" / "stage=normalized").exists()
    assert [r.id for r in stages.read_items(spark, path, items.schema, "reviewed").collect()] == [0]
    assert {r.collection_id: (r.normalized, r.review_status) for r in stages.manifest_of(stages.read_items(spark, path, items.schema), "id").collect()}["0"] == ("Y", "reviewed")


def test_limits(spark):
    from quillspark.functions.params import LIMITS, clamped, limit_of
    from quillspark.plans import relational, text

    for read, (default, least, most) in LIMITS.items():
        assert limit_of(read) == default and limit_of(read, least) == least and limit_of(read, most) == most
        for bad in (least - 1, most + 1):
            with pytest.raises(ValueError, match=read):
                limit_of(read, bad)
    assert [clamped(x, 1, 10) for x in (-3, 1, 7, 99)] == [1, 1, 7, 10]
    data = "/root/testdata/sf0.001"
    assert relational.recommended(spark, data, 3).count() == 3 and relational.search_keyword(spark, data, limit=2).count() == 2
    for call in (lambda: relational.list_recent(spark, data, 101), lambda: relational.wrong_answers(spark, data, 0), lambda: text.similar_cases(spark, data, top_k=21)):
        with pytest.raises(ValueError):
            call()
