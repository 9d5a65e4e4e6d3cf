"""Queries of sources, sinks, streams and models: they write what they read from the given tables and read it back."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veridoc.functions.session import shared_dir
from veridoc.operators import learning as M
from veridoc.plans.corpus import docs
from veridoc.plans.registry import query, table
from veridoc.sources import io
from veridoc.streaming import history as S


#: Files of one arrival of a stream.
FILES = 2

#: Rows of one log file.
LOG_ROWS = 5_000


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id // 50 AS folder, sha256(string_agg(text || chr(1), '' ORDER BY doc_id)) AS sha256, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size FROM documents GROUP BY 1")
def scan_raw_corpus(spark, sf_dir):
    """All documents as files of fifty in folders, scanned as a raw corpus."""
    where = place(spark, "raw")
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("folder"), "doc_id", "text")
    d.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "text").write.option("lineSep", "\u0001").partitionBy("folder").text(where)
    return io.scan_raw_corpus(spark, where, glob="*.txt").select(F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long").alias("folder"), "sha256", "size")


@query("SELECT event_id AS message_id, CASE event_type WHEN 'purchase' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events WHERE event_type IN ('purchase', 'error') AND event_id % 4 > 1")
def scan_submission_logs(spark, sf_dir):
    """All events as logs of some thousand each, in the order of the table, whatever their users and ids; a quarter has no messages and a quarter no file attached."""
    where = place(spark, "logs")
    key = F.col("event_id")
    log = F.struct(
        key.alias("message_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type") == "error", "FAIL").otherwise("UNKNOWN").alias("verdict"),
        F.when(key % 4 != 1, F.struct(F.md5(key.cast("string")).alias("sha256"), key.alias("size"))).alias("pdf"), F.when(key % 4 != 0, F.array(F.struct(F.lit("ok").alias("text")))).alias("messages"),
    )
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.floor(F.monotonically_increasing_id() / LOG_ROWS).alias("file"))
    # the bare rows are dealt out, not what they are written as
    e.repartition("file").groupBy("file").agg(F.collect_list(log).alias("logs")).select(F.to_json("logs").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(where)
    return io.scan_submission_logs(spark, where).select("message_id", "verdict")


@query("SELECT conv_id * 100 + turn AS id, role AS \"from\", role = 'user' AS is_upload FROM conversations")
def scan_chat_export(spark, sf_dir):
    where = place(spark, "chat")
    m = F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("from"), F.when(F.col("role") == "user", F.lit("file.pdf")).alias("file"), F.col("text"))
    # one export for each conversation
    table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(m).alias("messages")).select(F.to_json(F.struct("messages")).alias("value")).write.option("maxRecordsPerFile", 1).text(where)
    return io.scan_chat_export(spark, where).select("id", "from", "is_upload")


@query(
    """SELECT lang AS bank, source AS channel, 'n_chars' AS name, CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi, NULL AS value FROM documents GROUP BY 1, 2
    UNION ALL SELECT DISTINCT lang, 'all', 'source', NULL, NULL, source FROM documents"""
)
def scan_reference_specs(spark, sf_dir):
    where = place(spark, "specs")
    by = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.create_map(F.lit("n_chars"), F.array(F.min("n_chars").cast("double"), F.max("n_chars").cast("double"))).alias("m"))
    spec = by.groupBy(F.col("lang").alias("bank")).agg(F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("channels"), F.create_map(F.lit("all"), F.create_map(F.lit("source"), F.collect_set("source"))).alias("pools"))
    spec.select(F.to_json(F.struct("bank", "channels", "pools")).alias("value")).write.option("maxRecordsPerFile", 1).text(where)
    envelopes, pools = io.scan_reference_specs(spark, where)
    return envelopes.withColumnRenamed("metric", "name").withColumn("value", F.lit(None).cast("string")).unionByName(pools.withColumnRenamed("layer", "name"), allowMissingColumns=True)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def sink_dataset(spark, sf_dir):
    where = place(spark, "sink")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    io.sink_dataset(rows, where, "json")
    return spark.read.schema(rows.schema).json(where)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv_export(spark, sf_dir):
    where = place(spark, "export")
    rows = table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment")
    io.sink_csv_export(rows, where)
    return spark.read.schema(rows.select(*sorted(rows.columns)).schema).option("header", True).csv(where)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def sink_upsert(spark, sf_dir):
    """Even events as the current table's source, odd ones as new arrivals."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    empty = e.filter("false")
    current = io.sink_upsert(e.filter("event_id % 2 = 0"), empty, ["user_id"], "event_id")
    return io.sink_upsert(e.filter("event_id % 2 = 1"), current, ["user_id"], "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def sink_upsert_table(spark, sf_dir):
    """The same in a table of buckets: the even events, then the odd ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    users = io.UpsertTable(spark, place(spark, "upserts"), "user_id long, event_id long, event_type string", ["user_id"], "event_id", buckets=16)
    users.upsert(e.filter("event_id % 2 = 0"))
    users.upsert(e.filter("event_id % 2 = 1"))
    return users.read()


@query("SELECT 'customer' AS name, 'v1' AS version, count(*) AS n_rows, bit_xor(hash(c_custkey, c_name)) IS NOT NULL AS whole FROM customer UNION ALL SELECT 'supplier', 'v1', count(*), true FROM supplier")
def sink_versioned_artifacts(spark, sf_dir):
    """`whole`: the hash in the manifest is that of the given table, its rows in another order."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "supplier")}
    out = io.sink_versioned_artifacts(tables, place(spark, "artefacts"), "v1")
    again = io.sink_versioned_artifacts({n: df.orderBy(F.desc(df.columns[0])) for n, df in tables.items()}, place(spark, "artefacts"), "v1")
    return out.join(again.select("name", F.col("content_hash").alias("_h")), "name").select("name", "version", "n_rows", (F.col("content_hash") == F.col("_h")).alias("whole"))


def features(spark, sf_dir):
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    text = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[!#$%&*|]")).cast("double").alias("symbols"), F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("capitals"))
    return d.join(text, "doc_id").select("doc_id", "h", "lang", "source", F.col("len").cast("double").alias("len"), F.col("breaks").cast("double").alias("breaks"), "symbols", "capitals", F.col("quality").cast("int").alias("label"))


NUMERIC = ["len", "breaks", "symbols", "capitals"]


@query(
    """WITH d AS (SELECT doc_id, lang, CAST(length(text) AS DOUBLE) AS len, nullif(CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE), 0) AS capitals FROM documents JOIN labels USING (doc_id)),
       f AS (SELECT doc_id, lang, len, coalesce(capitals, (SELECT quantile_disc(capitals, 0.5) FROM d)) AS capitals FROM d),
       k AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS category FROM d GROUP BY lang)
       SELECT doc_id, round((len - avg(len) OVER ()) / stddev_samp(len) OVER (), 6) AS len_scaled, round((capitals - avg(capitals) OVER ()) / stddev_samp(capitals) OVER (), 6) AS capitals_scaled, category FROM f JOIN k USING (lang)"""
)
def feature_pipeline(spark, sf_dir):
    """The features of the labelled documents, numbers that are 0 as unknown ones; `category` is the place of the language's 1."""
    rows = features(spark, sf_dir).withColumn("capitals", F.nullif("capitals", F.lit(0.0)))
    out = M.feature_pipeline(["len", "capitals"], ["lang"]).fit(rows).transform(rows).withColumn("f", vector_to_array("features"))
    hot = F.array_position(F.slice("f", 3, F.size("f") - 2), F.lit(1.0))
    return out.select("doc_id", F.round(F.get("f", F.lit(0)), 6).alias("len_scaled"), F.round(F.get("f", F.lit(1)), 6).alias("capitals_scaled"), hot.alias("category"))


@query()
def logistic_model(spark, sf_dir):
    """(doc_id, score): the labelled documents' own scores; solvers differ in the last digits."""
    rows = features(spark, sf_dir)
    return M.fit_predict(rows, rows, NUMERIC, ["lang"], label="label").select("doc_id", F.round("score", 6).alias("score"))


@query()
def grouped_cv(spark, sf_dir):
    return M.grouped_cv(features(spark, sf_dir), "h", NUMERIC, ["lang"], label="label")


@query()
def temporal_holdout(spark, sf_dir):
    return M.temporal_holdout(features(spark, sf_dir), ["doc_id"], NUMERIC, ["lang"], label="label")


def drained(stream, name: str, mode: str = "append"):
    """The rows that a stream gives once all its input is read."""
    spark = stream.sparkSession
    where = place(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{where}-checkpoint").option("path", where).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(where)


def event_stream(spark, sf_dir):
    """The event log as four arrivals in the order of their times, each of them a batch of its own."""
    where = place(spark, "events")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    low, high = (x or 0 for x in e.agg(F.min(us), F.max(us)).head())
    step = (high - low) // 4 + 1
    for n in range(4):
        e.filter((us >= low + n * step) & (us < low + (n + 1) * step)).repartition(FILES).write.mode("append").parquet(where)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES).parquet(where)


@query("SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events")
def stream_daily_active(spark, sf_dir):
    return drained(S.stream_daily_active(event_stream(spark, sf_dir), "user_id", "ts"), "daily")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """The event stream read twice: each id comes out once."""
    twice = event_stream(spark, sf_dir).union(event_stream(spark, sf_dir))
    return drained(S.stream_dedup(twice, "event_id", "ts", watermark="1 hour"), "dedup").select("event_id", "user_id")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS checks, count(*) FILTER (WHERE value > 50) AS fakes FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) - 1 FROM events) GROUP BY 1, 2")
def stream_verdict_counts(spark, sf_dir):
    """Days that the watermark of a day has passed."""
    return drained(S.stream_verdict_counts(event_stream(spark, sf_dir), "ts", "event_type", F.col("value") > 50), "counts")


def sightings(spark, sf_dir):
    """Orders as sightings of their customer's id, in the order of their keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where = place(spark, "sightings")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.timestamp_seconds("o_orderkey").alias("at"))
    o.write.parquet(where)
    return spark.readStream.schema(o.schema).parquet(where)


@query(
    """SELECT o_orderkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS use_no, o_orderstatus <> first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS conflict,
    o_orderpriority <> first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS by_other FROM orders"""
)
def stream_identity(spark, sf_dir):
    stream = sightings(spark, sf_dir)
    out = S.stream_identity(stream, id_col="o_custkey", file_col="o_orderkey", signature_col="o_orderstatus", user_col="o_orderpriority", at_col="at")
    return drained(out, "identity").select(F.col("file").cast("long").alias("file"), "use_no", "conflict", "by_other")


@query(
    """SELECT o_orderkey AS file, row_number() OVER w AS use_no, o_orderpriority <> first_value(o_orderpriority) OVER w AS by_other, CAST(first_value(o_orderkey) OVER w AS DOUBLE) AS first_at
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def stream_reuse(spark, sf_dir):
    out = S.stream_reuse(sightings(spark, sf_dir), id_col="o_custkey", user_col="o_orderpriority", at_col="at", file_col="o_orderkey")
    return drained(out, "reuse").select(F.col("file").cast("long").alias("file"), "use_no", "by_other", "first_at")


KEPT_MS = 5 * 86_400_000


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type, user_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT event_id, event_type, user_id, i, ms AS first, false AS seen FROM e WHERE i = 1
          UNION ALL
          SELECT e.event_id, e.event_type, e.user_id, e.i, CASE WHEN r.first + {KEPT_MS} <= e.ms THEN e.ms ELSE r.first END, r.first + {KEPT_MS} > e.ms FROM r JOIN e ON e.event_type = r.event_type AND e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT event_id, seen FROM r"""
)
def stream_newest(spark, sf_dir):
    """Users that each kind of event has seen, forgotten five days after they came."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = S.stream_newest(event_stream(spark, sf_dir), store="event_type", id_col="user_id", file_col="event_id", signature_col="event_type", ts="ts", most=1_000_000, keep_ms=KEPT_MS, watermark="1 hour")
    return drained(out, "newest").select(F.col("file").cast("long").alias("event_id"), "seen")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count FROM events GROUP BY 1")
def stream_user_dim(spark, sf_dir):
    """The user dimension, merged batch by batch; each batch writes a version of its own, so a batch run again changes nothing."""
    where = place(spark, "users")
    schema = "user_id long, first_seen timestamp, last_seen timestamp, seen_count long"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(before):
        """The last complete version below `before`, as the folder itself tells."""
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path(where)) if fs.exists(path(s.getPath(), "_SUCCESS"))] if fs.exists(path(where)) else []
        last = max((n for n in done if n < before), default=None)
        return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{where}/v{last}")

    def merge(batch, current):
        new = batch.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("seen_count"))
        return current.unionByName(new).groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))

    def write(rows, n):
        rows.write.mode("overwrite").parquet(f"{where}/v{n}")

    q = event_stream(spark, sf_dir).writeStream.foreachBatch(S.stream_user_dim(merge, read, write)).option("checkpointLocation", f"{where}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read(1 << 62).withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS submissions FROM s GROUP BY user_id, n"""


@query(SESSIONS)
def sessions(spark, sf_dir):
    """Submissions of a user with six hours at most between them."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ntz(S.sessions(e, "user_id", "ts", gap="6 hours"))


def _ntz(df):
    return df.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("ended", F.col("ended").cast("timestamp_ntz"))


@query(f"SELECT * FROM ({SESSIONS}) WHERE ended + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark of a day has passed."""
    return _ntz(drained(S.stream_sessions(event_stream(spark, sf_dir), "user_id", "ts", gap="6 hours", watermark="1 day"), "sessions"))


@query("SELECT event_id, user_id FROM events")
def stream_log_tail(spark, sf_dir):
    where = place(spark, "tail")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows.repartition(4).write.json(where)
    return drained(S.stream_log_tail(spark, where, rows.schema, files_per_trigger=2), "tailed")


@query(
    """WITH e AS (SELECT event_type, ts, unnest([0, 30]) AS back FROM events), w AS (SELECT time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '2000-01-01') - to_seconds(back) AS start, event_type FROM e)
    SELECT start, count(*) AS submissions, count(*) FILTER (WHERE event_type = 'purchase') AS passes FROM w
    WHERE start + INTERVAL 60 SECOND <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY 1"""
)
def stream_bursts(spark, sf_dir):
    """Windows that the watermark has passed."""
    out = drained(S.stream_bursts(event_stream(spark, sf_dir), "ts", F.col("event_type") == "purchase"), "bursts")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
