"""History queries: the event log as submissions, `purchase` as pass and `error` as fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.operators import history as H
from veridoc.plans.registry import query, table

VERDICT = "CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'FAIL' ELSE 'UNKNOWN' END"
ORDER = ["ts", "event_id"]


def submissions(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.expr(VERDICT).alias("verdict"), F.get_json_object("props", "$.k").alias("k"))


SUBMISSIONS = f"(SELECT event_id, ts, user_id, event_type, value, {VERDICT} AS verdict, json_extract_string(props, '$.k') AS k FROM events)"


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS send_index FROM events")
def send_index(spark, sf_dir):
    return H.send_index(submissions(spark, sf_dir).select("event_id", "ts"), ORDER).select("event_id", "send_index")


@query(f"SELECT event_id, coalesce(lag(verdict) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS previous_verdict FROM {SUBMISSIONS}")
def previous_verdict(spark, sf_dir):
    return H.previous_verdict(submissions(spark, sf_dir), "verdict", ORDER, partition=["user_id"]).select("event_id", "previous_verdict")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 3) AS gap_seconds FROM events")
def gap_seconds(spark, sf_dir):
    return H.gap_seconds(submissions(spark, sf_dir), "ts", ORDER, partition=["user_id"]).select("event_id", F.round("gap_seconds", 3).alias("gap_seconds"))


@query(f"SELECT event_id, coalesce(lag(verdict) OVER (ORDER BY ts, event_id), '') AS previous_verdict, round((epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6, 3) AS gap_seconds FROM {SUBMISSIONS}")
def global_previous(spark, sf_dir):
    """The row before in the whole history, whoever sent it."""
    rows = H.gap_seconds(H.previous_verdict(submissions(spark, sf_dir), "verdict", ORDER), "ts", ORDER)
    return rows.select("event_id", "previous_verdict", F.round("gap_seconds", 3).alias("gap_seconds"))


@query(
    "SELECT event_id, "
    + ", ".join(f"count(*) {f}OVER (ORDER BY epoch_us(ts) // 60000000 RANGE BETWEEN {m} PRECEDING AND CURRENT ROW) - count(*) {f}OVER (PARTITION BY epoch_us(ts) // 60000000 ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS prior_{x}{60 * m}s" for m in (1, 5, 60) for x, f in (("", ""), ("pass_", "FILTER (WHERE verdict = 'PASS') ")))
    + f" FROM {SUBMISSIONS}"
)
def global_prior_counts(spark, sf_dir):
    """Times by the minute, so that many are equal and frames end on them."""
    minute = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 60).cast("timestamp")
    out = H.prior_window_counts(submissions(spark, sf_dir).withColumn("minute", minute), "minute", F.col("verdict") == "PASS", ["minute", "event_id"], seconds=(60, 300, 3600))
    return out.select("event_id", *[f"prior_{x}{s}s" for s in (60, 300, 3600) for x in ("", "pass_")])


@query(
    f"""SELECT event_id, CAST(sum(one) OVER (PARTITION BY island ORDER BY ts, event_id) AS BIGINT) AS streak, uploads AS upload_no FROM (SELECT *, sum(CASE WHEN NOT clean AND NOT again THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS island, CASE WHEN clean AND NOT again THEN 1 ELSE 0 END AS one,
      CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS uploads
    FROM (SELECT *, event_type <> 'error' AS clean, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS again FROM {SUBMISSIONS}))"""
)
def global_streak(spark, sf_dir):
    """The streak of the whole history, a user's event of one kind and day counting once; and the uploads so far."""
    rows = submissions(spark, sf_dir).withColumn("mid", F.concat_ws("/", "user_id", F.to_date("ts"), "event_type"))
    out = H.clean_streak(rows, F.col("event_type") != "error", ORDER, ids="mid")
    return H.reply_attribution(out, F.col("event_type") == "view", ORDER).select("event_id", "streak", "upload_no")


@query(
    f"""SELECT a.event_id, count(b.event_id) FILTER (WHERE b.ts >= a.ts - INTERVAL 60 SECOND) AS prior_60s,
       count(b.event_id) FILTER (WHERE b.ts >= a.ts - INTERVAL 60 SECOND AND b.verdict = 'PASS') AS prior_pass_60s,
       count(b.event_id) AS prior_300s, count(b.event_id) FILTER (WHERE b.verdict = 'PASS') AS prior_pass_300s
    FROM {SUBMISSIONS} a LEFT JOIN {SUBMISSIONS} b ON a.event_type = b.event_type AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.ts >= a.ts - INTERVAL 300 SECOND
    GROUP BY a.event_id"""
)
def prior_window_counts(spark, sf_dir):
    out = H.prior_window_counts(submissions(spark, sf_dir), "ts", F.col("verdict") == "PASS", ORDER, partition=["event_type"])
    return out.select("event_id", *[F.col(f"prior_{x}{s}s").cast("long").alias(f"prior_{x}{s}s") for s in (60, 300) for x in ("", "pass_")])


@query(
    "SELECT event_id, "
    + ", ".join(
        f"count(*) OVER w_{k} AS prior_{k}_rows, count(*) FILTER (WHERE verdict = 'PASS') OVER w_{k} AS prior_{k}_passes, count(*) FILTER (WHERE verdict <> 'PASS') OVER w_{k} AS prior_{k}_fails" for k in ("user_id", "event_type")
    )
    + f" FROM {SUBMISSIONS} WINDOW "
    + ", ".join(f"w_{k} AS (PARTITION BY {k} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for k in ("user_id", "event_type"))
)
def prior_same_key(spark, sf_dir):
    out = H.prior_same_key(submissions(spark, sf_dir), ["user_id", "event_type"], F.col("verdict") == "PASS", ORDER)
    return out.select("event_id", *[c for c in out.columns if c.startswith("prior_")])


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count FROM events GROUP BY user_id")
def first_seen(spark, sf_dir):
    return H.first_seen(submissions(spark, sf_dir), "user_id", "ts")


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS is_unique FROM documents")
def unique_in_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return H.unique_in_batch(docs, "h", ["doc_id"]).select("doc_id", "is_unique")


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type || CAST(day(ts) AS VARCHAR) AS mid, verdict = 'PASS' AS clean, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {SUBMISSIONS}),
       r AS (SELECT event_id, user_id, i, CAST(clean AS BIGINT) AS streak, CASE WHEN clean THEN [mid] ELSE [] END AS recent FROM e WHERE i = 1
             UNION ALL
             SELECT e.event_id, e.user_id, e.i, CASE WHEN list_contains(r.recent, e.mid) THEN r.streak WHEN e.clean THEN r.streak + 1 ELSE 0 END,
               CASE WHEN e.clean AND NOT list_contains(r.recent, e.mid) THEN list_append(r.recent, e.mid)[-3:] ELSE r.recent END
             FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1)
       SELECT event_id, streak FROM r"""
)
def recent_streak(spark, sf_dir):
    """A user's event of one kind and day of the month is passed over while it is one of the last three that counted."""
    rows = submissions(spark, sf_dir).withColumn("mid", F.concat("event_type", F.dayofmonth("ts").cast("string")))
    return H.clean_streak(rows, F.col("verdict") == "PASS", ORDER, partition=["user_id"], ids="mid", last=3).select("event_id", "streak")


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type || coalesce(json_extract_string(props, '$.k'), '') AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       r AS (SELECT event_id, user_id, i, false AS seen_recently, [h] AS recent FROM e WHERE i = 1
             UNION ALL
             SELECT e.event_id, e.user_id, e.i, list_contains(r.recent, e.h), CASE WHEN list_contains(r.recent, e.h) THEN r.recent ELSE list_append(r.recent, e.h)[-3:] END
             FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1)
       SELECT event_id, seen_recently FROM r"""
)
def seen_recently(spark, sf_dir):
    rows = submissions(spark, sf_dir).withColumn("h", F.concat("event_type", F.coalesce("k", F.lit(""))))
    return H.seen_recently(rows, "h", ORDER, partition=["user_id"], n=3).select("event_id", "seen_recently")


@query(
    """SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used,
       row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events"""
)
def daily_quota(spark, sf_dir):
    return H.daily_quota(submissions(spark, sf_dir), "user_id", "ts", ORDER, limit=2).select("event_id", "day", "used", "allowed")


@query(
    f"""SELECT event_id, count(*) FILTER (WHERE verdict <> 'FAIL') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM
    (SELECT *, sum(CASE WHEN verdict = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM {SUBMISSIONS})"""
)
def clean_streak(spark, sf_dir):
    return H.clean_streak(submissions(spark, sf_dir), F.col("verdict") != "FAIL", ORDER, partition=["user_id"]).select("event_id", "streak")


@query(
    f"""SELECT *, caught - lag(caught) OVER (ORDER BY round) AS caught_delta, CASE sign(caught - lag(caught) OVER (ORDER BY round)) WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'same' END AS caught_trend,
      missed - lag(missed) OVER (ORDER BY round) AS missed_delta, CASE sign(missed - lag(missed) OVER (ORDER BY round)) WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'same' END AS missed_trend
    FROM (SELECT CAST(ts AS DATE) AS round, count(*) FILTER (WHERE verdict = 'FAIL') AS caught, count(*) FILTER (WHERE verdict = 'PASS') AS missed FROM {SUBMISSIONS} GROUP BY 1)"""
)
def round_trend(spark, sf_dir):
    rounds = submissions(spark, sf_dir).groupBy(F.to_date("ts").alias("round")).agg(F.count_if(F.col("verdict") == "FAIL").alias("caught"), F.count_if(F.col("verdict") == "PASS").alias("missed"))
    return H.round_trend(rounds, "round", ["caught", "missed"])


SPANS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(round(l_quantity) AS BIGINT) AS x0, CAST(round(l_quantity) AS BIGINT) + 3 AS x1 FROM lineitem)"
SPAN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def spans(spark, sf_dir):
    x0 = F.round("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *SPAN_ORDER, x0.alias("x0"), (x0 + 3).alias("x1"))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gap, coalesce(abs(gap) > 20, false) AS hard_gap FROM
    (SELECT *, lead(x0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - x1 AS gap FROM {SPANS})"""
)
def adjacent_gaps(spark, sf_dir):
    return H.adjacent_gaps(spans(spark, sf_dir), "l_orderkey", SPAN_ORDER, "x0", "x1", hard=20).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "gap", "hard_gap")


@query(
    f"""SELECT l_orderkey, max(n) AS longest_run FROM (SELECT l_orderkey, run, count(*) AS n FROM (SELECT l_orderkey, sum(step) OVER w AS run FROM
      (SELECT *, CASE WHEN l_linenumber = lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 THEN 0 ELSE 1 END AS step FROM {SPANS})
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2) GROUP BY 1"""
)
def ascending_run(spark, sf_dir):
    return H.ascending_run(spans(spark, sf_dir), "l_orderkey", SPAN_ORDER, "l_linenumber")


CORE = ("<head>", "<title>", "<body>", "<h1>", "</html>")


@query(
    "SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN instr(html, '{c}') = 0 THEN '{c}' END" for c in CORE) + "], lambda x: x IS NOT NULL), ',') AS missing, "
    "list_filter([" + ", ".join(f"instr(html, '{c}')" for c in CORE) + "], lambda x: x > 0) = list_sort(list_filter([" + ", ".join(f"instr(html, '{c}')" for c in CORE) + "], lambda x: x > 0)) AS in_order FROM pages"
)
def field_order(spark, sf_dir):
    return H.field_order(table(spark, sf_dir, "pages"), "page_id", "html", CORE)


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upload_no FROM conversations")
def reply_attribution(spark, sf_dir):
    return H.reply_attribution(table(spark, sf_dir, "conversations"), F.col("role") == "user", ["turn"], partition=["conv_id"]).select("conv_id", "turn", "upload_no")


@query("SELECT signature, count(*) AS variants FROM (SELECT conv_id, sha256(string_agg(role, '>' ORDER BY turn, role)) AS signature FROM conversations GROUP BY conv_id) GROUP BY signature")
def order_signature(spark, sf_dir):
    return H.order_signature(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role").groupBy("signature").agg(F.count("*").alias("variants"))


@query("SELECT user_id, max_by(event_type, event_id) AS latest_name FROM events GROUP BY user_id")
def latest_name(spark, sf_dir):
    return H.latest_name(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM events")
def temporal_split(spark, sf_dir):
    return H.temporal_split(table(spark, sf_dir, "events").select("event_id", "ts"), ORDER).select("event_id", "split")
