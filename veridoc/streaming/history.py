"""The history checks on streams. Every operator takes a streaming DataFrame and gives one; state is bounded by a watermark or a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_log_tail(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 100) -> DataFrame:
    """Rows of JSON lines files as they arrive; the checkpoint keeps which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_dedup(df: DataFrame, key: str, ts: str, *, watermark: str) -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_daily_active(df: DataFrame, user: str, ts: str, *, watermark: str = "1 day") -> DataFrame:
    """(day, user), each pair once, while the day is within the watermark."""
    day = F.window(ts, "1 day")["start"]
    return df.withWatermark(ts, watermark).select(day.alias("day"), F.col(user), F.col(ts)).dropDuplicatesWithinWatermark(["day", user]).select(F.to_date("day").alias("day"), user)


def stream_bursts(df: DataFrame, ts: str, passed: Column, *, window: str = "60 seconds", slide: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Submissions and passes in sliding windows: the approximation of the row-exact batch counts that streams allow."""
    return df.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide)).agg(F.count("*").alias("submissions"), F.count_if(passed).alias("passes")).select(F.col("window.start").alias("start"), "submissions", "passes")


def sessions(df: DataFrame, user: str, ts: str, *, gap: str) -> DataFrame:
    """(user, started, ended, submissions): runs of a user's submissions with no more than `gap` between them. A row without a time is in none.

    Works on a table and on a stream with a watermark; there a late row that lies between two open sessions makes them one.
    """
    out = df.filter(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap), user).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("submissions"))
    return out.select(user, "started", "ended", "submissions")


def stream_sessions(df: DataFrame, user: str, ts: str, *, gap: str, watermark: str) -> DataFrame:
    """`sessions`, each told once the watermark has passed the time up to which it could go on."""
    return sessions(df.withWatermark(ts, watermark), user, ts, gap=gap)


def stream_verdict_counts(df: DataFrame, ts: str, bank: str, fake: Column, *, watermark: str = "1 day") -> DataFrame:
    """(day, bank, checks, fakes), told when the day is past the watermark."""
    out = df.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), bank).agg(F.count("*").alias("checks"), F.count_if(fake).alias("fakes"))
    return out.select(F.to_date("window.start").alias("day"), bank, "checks", "fakes")


def stream_user_dim(merge: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: merges a batch into the dimension as it was before it and writes it as the batch's own version.

    `read` takes the batch's number and gives the last version below it, so nothing is kept in the driver: a
    batch that is run again, also after a restart, overwrites its version with the same rows.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        write(merge(batch, read(number)), number)

    return upsert


class _Newest(StatefulProcessor):
    """Keeps for each store the `most` ids first seen last, and each no longer than `keep_ms` of event time after its first sighting."""

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "signature string, file string, at double")

    def _due(self, at: float) -> int:
        return int(at * 1000) + self.keep_ms

    def _wake(self, known: dict[str, tuple]) -> None:
        """One timer, for the id whose time is up first; it sets the next."""
        if known:
            self.handle.registerTimer(self._due(min(v[2] for v in known.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id", "file"], kind="stable")
        known = {k[0]: tuple(v) for k, v in self.ids.iterator()}
        before, out = dict(known), []
        for r in batch.itertuples(index=False):
            # by event time, also where no timer has run since
            first = known.get(r.id)
            if first is not None and self._due(first[2]) <= int(r.at * 1000):
                del known[r.id]
                first = None
            out.append((*key, r.id, r.file, first is not None, bool(first is not None and r.signature != first[0] and r.file != first[1])))
            if first is None:
                known[r.id] = (r.signature, r.file, float(r.at))
                if len(known) > self.most:
                    del known[min(known, key=lambda k: (known[k][2], k))]
        for k in before.keys() - known.keys():
            self.ids.removeKey((k,))
        for k in (k for k, v in known.items() if before.get(k) != v):
            self.ids.updateValue((k,), known[k])
        self._wake(known)
        yield pd.DataFrame(out, columns=["store", "id", "file", "seen", "conflict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = {k[0]: tuple(v) for k, v in self.ids.iterator()}
        for k in [k for k, v in known.items() if self._due(v[2]) <= now]:
            self.ids.removeKey((k,))
            del known[k]
        self._wake(known)
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("store", str), ("id", str), ("file", str), ("seen", bool), ("conflict", bool))})

    def close(self) -> None:
        pass


def stream_newest(df: DataFrame, *, store: str, id_col: str, file_col: str, signature_col: str, ts: str, most: int, keep_ms: int, watermark: str) -> DataFrame:
    """(store, id, file, seen, conflict): each sighting against the ids that its store still keeps.

    A store keeps the `most` ids that it first saw last, each for `keep_ms` of event time from its first sighting; an id
    that has gone is new again. `conflict` is another signature from another file. Rows of one batch are taken in (time,
    id, file) order. Ids, stores or times that are null have no state and are left out. State is bounded by `most` for
    each store. Needs the RocksDB state store.
    """
    rows = df.withWatermark(ts, watermark).filter(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "") & F.col(store).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(*[F.col(c).cast("string").alias(n) for c, n in ((store, "store"), (id_col, "id"), (file_col, "file"), (signature_col, "signature"))], (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), F.col(ts).alias("_ts"))
    return rows.groupBy("store").transformWithStateInPandas(_Newest(most, keep_ms), "store string, id string, file string, seen boolean, conflict boolean", "Append", "EventTime")


class _FirstSignature(StatefulProcessor):
    """Keeps the first (signature, file) of an id and the number of its sightings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "signature string, file string, user string, n long, at double", ttlDurationMs=self.ttl_ms)

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "file"], kind="stable")
        known = self.first.get() if self.first.exists() else None
        out = []
        for r in batch.itertuples(index=False):
            if known is None:
                known = (r.signature, r.file, r.user, 0, float(r.at))
            out.append((key[0], r.file, known[3] + 1, bool(r.signature != known[0] and r.file != known[1]), bool(r.user != known[2]), known[4]))
            known = (*known[:3], known[3] + 1, known[4])
        self.first.update(known)
        yield pd.DataFrame(out, columns=["id", "file", "use_no", "conflict", "by_other", "first_at"])

    def close(self) -> None:
        pass


def stream_identity(df: DataFrame, *, id_col: str, file_col: str, signature_col: str, user_col: str, at_col: str, ttl_ms: int = 0) -> DataFrame:
    """(id, file, use_no, conflict, by_other, first_at): each sighting of an id against the first one that the stream kept.

    `conflict` is another signature from another file; `use_no` and `by_other` are the reuse of the id. Rows of one
    batch are taken in (time, file) order; ids that are null or empty have no identity and go before. Needs the
    RocksDB state store.
    """
    at = F.unix_micros(F.col(at_col).cast("timestamp")) / 1e6
    rows = df.filter(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")).select(*[F.col(c).cast("string").alias(n) for c, n in ((id_col, "id"), (file_col, "file"), (signature_col, "signature"), (user_col, "user"))], at.alias("at"))
    return rows.groupBy("id").transformWithStateInPandas(_FirstSignature(ttl_ms), "id string, file string, use_no long, conflict boolean, by_other boolean, first_at double", "Append", "None")


def stream_reuse(df: DataFrame, *, id_col: str, user_col: str, at_col: str, file_col: str, ttl_ms: int = 0) -> DataFrame:
    """(id, file, use_no, by_other, first_at) of every use of a key."""
    return stream_identity(df, id_col=id_col, file_col=file_col, signature_col=id_col, user_col=user_col, at_col=at_col, ttl_ms=ttl_ms).drop("conflict")
