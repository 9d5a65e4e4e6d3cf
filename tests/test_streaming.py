"""Streams give what the batch operators give on the same rows."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import veridoc.plans  # noqa: F401
from veridoc.functions.session import shared_dir
from veridoc.plans.registry import QUERIES
from veridoc.plans.sources import drained
from veridoc.sources import io
from veridoc.streaming import history as S

T0 = datetime(2024, 1, 1)


@pytest.fixture
def source(spark):
    """Makes a stream of rows, a file for each list of them."""

    def make(batches, schema):
        where = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)

    return make


def at(s):
    return T0 + timedelta(seconds=s)


def test_dedup_over_batches(source):
    schema = "id long, ts timestamp"
    got = drained(S.stream_dedup(source([[(1, at(0)), (1, at(1)), (2, at(2))], [(1, at(3)), (3, at(4))]], schema), "id", "ts", watermark="1 hour"), "d")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_daily_active_once_a_day(source):
    rows = [[("u", at(0)), ("u", at(5))], [("u", at(86400)), ("v", at(10)), (None, at(11))]]
    got = drained(S.stream_daily_active(source(rows, "user string, ts timestamp"), "user", "ts", watermark="2 days"), "a")
    assert sorted((str(r["day"]), str(r["user"])) for r in got.collect()) == [("2024-01-01", "None"), ("2024-01-01", "u"), ("2024-01-01", "v"), ("2024-01-02", "u")]


def test_late_rows_are_not_counted_and_open_days_not_told(source):
    rows = [[("b", at(0)), ("b", at(10))], [("b", at(4 * 86400))], [("b", at(4 * 86400 + 5))], [("b", at(20))]]
    got = drained(S.stream_verdict_counts(source(rows, "bank string, ts timestamp"), "ts", "bank", F.lit(True)), "v")
    assert [(str(r["day"]), r["checks"]) for r in got.collect()] == [("2024-01-01", 2)]


def test_identity_over_batches(spark, source):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id string, file string, sig string, user string, ts timestamp"
    rows = [[("x", "f1", "s1", "u", at(0)), ("", "f0", "s9", "u", at(0)), (None, "f9", "s9", "u", at(0))], [("x", "f1", "s2", "u", at(1)), ("x", "f2", "s1", "v", at(2)), ("x", "f3", "s2", "u", at(3))]]
    out = S.stream_identity(source(rows, schema), id_col="id", file_col="file", signature_col="sig", user_col="user", at_col="ts")
    got = sorted((r["use_no"], r["file"], r["conflict"], r["by_other"]) for r in drained(out, "i").collect())
    assert got == [(1, "f1", False, False), (2, "f1", False, False), (3, "f2", False, True), (4, "f3", True, False)]
    uses = S.stream_reuse(source(rows, schema), id_col="id", user_col="user", at_col="ts", file_col="file")
    assert sorted(r["use_no"] for r in drained(uses, "r").collect()) == [1, 2, 3, 4]


def test_newest_ids_and_their_time(spark, source):
    """A store keeps two ids, each for a hundred seconds of event time: what has left, by number or by time, is new again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "store string, id string, file string, sig string, ts timestamp"
    batches = [
        [("s", "a", "f1", "1", at(0)), ("s", "a", "f2", "2", at(1)), ("t", "a", "f3", "9", at(1)), ("s", "", "f4", "1", at(2)), (None, "a", "f5", "1", at(2))],
        [("s", "b", "f6", "1", at(10)), ("s", "c", "f7", "1", at(20))],  # a leaves
        [("s", "a", "f8", "3", at(30)), ("s", "c", "f9", "1", at(31)), ("t", "a", "f3", "8", at(99))],  # a is new, b leaves
        [("t", "a", "f10", "7", at(150)), ("s", "c", "f11", "1", at(119))],  # t's a has had its time, s's c not yet
        [("s", "c", "f12", "1", at(400))], [("s", "c", "f13", "1", at(401))],
    ]
    out = S.stream_newest(source(batches, schema), store="store", id_col="id", file_col="file", signature_col="sig", ts="ts", most=2, keep_ms=100_000, watermark="1 minute")
    got = {r["file"] + r["store"]: (r["seen"], r["conflict"]) for r in drained(out, "n").collect() if r["file"] != "f3"}
    assert got == {"f1s": (False, False), "f2s": (True, True), "f6s": (False, False), "f7s": (False, False), "f8s": (False, False), "f9s": (True, False), "f10t": (False, False), "f11s": (True, False), "f12s": (False, False), "f13s": (True, False)}


def test_a_late_row_joins_two_sessions(source):
    schema = "user string, ts timestamp"
    rows = [[("u", at(0)), ("u", at(10))], [("u", at(100)), ("v", at(100))], [("u", at(55)), (None, at(56)), ("u", None)], [("z", at(9999))], [("z", at(10000))]]
    got = drained(S.stream_sessions(source(rows, schema), "user", "ts", gap="1 minute", watermark="5 minutes"), "s")
    assert sorted((str(r["user"]), r["started"], r["ended"], r["submissions"]) for r in got.collect()) == [("None", at(56), at(56), 1), ("u", at(0), at(100), 4), ("v", at(100), at(100), 1)]


def test_upserts_rewrite_only_what_they_touch(spark):
    where = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    t = io.UpsertTable(spark, where, "k long, v string, at long", ["k"], "at", buckets=8)
    rows = {k: ("old", 1) for k in range(100)}
    assert t.read().count() == 0
    assert t.upsert(spark.createDataFrame([(k, *v) for k, v in rows.items()], t.schema)) == list(range(8))
    before = t._manifest()[1]["folders"]
    new = [(3, "new", 2), (3, "newest", 3), (4, "older", 0), (5, "same", 1), (None, "none", 1), (3, "newer", None)]
    touched = t.upsert(spark.createDataFrame(new, t.schema), batch=1)
    after = t._manifest()[1]["folders"]
    assert 0 < len(touched) < 8 and {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    rows |= {3: ("newest", 3), 5: ("same", 1), None: ("none", 1)}
    assert {r["k"]: (r["v"], r["at"]) for r in t.read().collect()} == rows
    assert t.upsert(spark.createDataFrame([(7, "again", 9)], t.schema), batch=1) == []  # a batch that runs again
    # of two writers of one version one loses, and makes its change again
    number, manifest = t._manifest()
    assert t._commit(number + 1, manifest) and not t._commit(number + 1, manifest)
    t.upsert(spark.createDataFrame([(8, "won", 9)], t.schema))
    assert {r["k"]: r["v"] for r in t.read().collect()}[8] == "won" and t._manifest()[0] == number + 2
    with pytest.raises(ValueError, match="8 buckets"):
        io.UpsertTable(spark, where, t.schema, ["k"], "at", buckets=9).upsert(spark.createDataFrame([(8, "x", 9)], t.schema))


def test_log_scan_skips_what_is_no_submission(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"message_id": 1, "verdict": "PASS", "pdf": {"sha256": "x", "size": 3}, "messages": [{"text": "ok"}]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"message_id": 2, "verdict": "UNKNOWN", "pdf": {"sha256": "x"}, "messages": [{"text": "ok"}]}')
    (tmp_path / "d.json").write_text('{"message_id": 3, "verdict": "PASS", "messages": []}')
    assert [r["message_id"] for r in io.scan_submission_logs(spark, str(tmp_path)).collect()] == [1]


def test_logs_are_no_more_files_than_their_rows_fill(spark, tmp_path):
    """A file of its own for each user, or each block of ids, was 90,000 files at sixty times sf0.1."""
    n = 3000
    rows = [(i * 1_000_003, T0, i, "purchase") for i in range(n)] + [(2, None, None, "error"), (2, None, None, "error"), (None, T0, 1, "error"), (6, T0, 1, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["scan_submission_logs"](spark, str(tmp_path))
    assert len(out.inputFiles()) == 1
    assert sorted(map(tuple, out.collect())) == sorted([(2, "FAIL")] * 2 + [(1_000_003 * i, "PASS") for i in range(n) if 1_000_003 * i % 4 > 1])


def test_a_version_is_written_once(spark, tmp_path):
    tables = {"t": spark.range(10)}
    first = io.sink_versioned_artifacts(tables, str(tmp_path), "v1").head()
    assert first["n_rows"] == 10 and first["content_hash"] == io.sink_versioned_artifacts({"t": spark.range(10).repartition(3)}, str(tmp_path), "v2").head()["content_hash"]
    with pytest.raises(Exception, match="(?i)exist"):
        io.sink_versioned_artifacts(tables, str(tmp_path), "v1")
