"""STR-1 / STR-2 semantics on hand-made landing folders."""

import datetime as dt
import os
import tempfile

from quarry.streaming.corpus_stream import dedup_within_watermark, period_counts, read_stream, run_available_now

SCHEMA = "url string, ts timestamp_ntz, title string"


def _land(spark, d, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(d, name))


def test_first_arrival_wins_within_watermark(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    t0 = dt.datetime(2024, 1, 1, 12)
    _land(spark, d, "b1", [("u1", t0, "first"), ("u2", t0, "x")])
    _land(spark, d, "b2", [("u1", t0 + dt.timedelta(hours=1), "second"), ("u3", t0, "y")])
    s = read_stream(spark, os.path.join(d, "*"), SCHEMA, max_files_per_trigger=1)
    out = run_available_now(dedup_within_watermark(s, ["url"], "ts", "1 day"), "test_dedup")
    got = {r["url"]: r["title"] for r in out.collect()}
    assert got == {"u1": "first", "u2": "x", "u3": "y"}


def test_closed_windows_only(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    base = dt.datetime(2024, 1, 1)
    _land(spark, d, "b1", [(f"u{i}", base + dt.timedelta(days=i), "t") for i in range(10)])
    s = read_stream(spark, os.path.join(d, "*"), SCHEMA)
    out = run_available_now(period_counts(s, "ts", [], "7 days", "1 day", "1 day"), "test_windows")
    rows = out.collect()
    wm = base + dt.timedelta(days=9) - dt.timedelta(days=1)
    assert rows and all(r["window_end"] <= wm for r in rows)
    # the window [Jan 1, Jan 8) holds days 0..6
    assert {(r["window_start"], r["n"]) for r in rows} >= {(base, 7)}


def test_dedup_does_not_depend_on_files_inside_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"u{i % 7}", t0 + dt.timedelta(days=i), str(i)) for i in range(28)]
    for n_files in (1, 4):
        d = tempfile.mkdtemp(prefix="quarry-test-")
        for k in range(n_files):
            _land(spark, d, f"b{k}", rows[k::n_files])
        s = read_stream(spark, os.path.join(d, "*"), SCHEMA, max_files_per_trigger=1)
        out = run_available_now(dedup_within_watermark(s, ["url"], "ts", "60 days"), f"test_dedup_{n_files}")
        assert sorted(r["url"] for r in out.collect()) == [f"u{i}" for i in range(7)]
