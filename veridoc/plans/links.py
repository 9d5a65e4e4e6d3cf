"""Queries of joins, sets and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.operators import links as L
from veridoc.plans.corpus import DOCS, docs
from veridoc.plans.history import ORDER, SUBMISSIONS, submissions
from veridoc.plans.registry import query, table


@query(
    "SELECT doc_id, source, quality, 'log' AS origin FROM (SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0) LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, NULL, quality, 'chat' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)"
)
def log_chat_merge(spark, sf_dir):
    logs = table(spark, sf_dir, "documents").filter("doc_id % 3 != 0").select("doc_id", "source")
    return L.log_chat_merge(logs, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT c_custkey AS key, c_name AS name, NULL AS phone FROM customer UNION ALL SELECT s_suppkey, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier")
def log_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return L.log_union(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("string").alias("phone")))


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN lang || '/' || n_chars % 40 END AS key, n_chars % 7 AS n_chars FROM documents),
      c AS (SELECT CASE WHEN doc_id % 13 > 0 THEN lang || '/' || n_chars % 50 END AS key, 'chat' AS kind, 'c' || doc_id AS path, doc_id % 7 AS size FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT lang || '/' || n_chars % 60, 'disk', 'd' || doc_id, n_chars % 7 FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, key, n_chars, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN size = n_chars AND kind = 'chat' THEN 0 WHEN size = n_chars THEN 1 WHEN kind = 'chat' THEN 2 ELSE 3 END, path NULLS LAST) AS r FROM d LEFT JOIN c USING (key)) WHERE r = 1"""
)
def resolve_copy(spark, sf_dir):
    """Keys that rows and candidates share by the dozen, and rows and candidates without one."""
    d, key = docs(spark, sf_dir), lambda n: F.concat_ws("/", "lang", F.col("n_chars") % n)
    rows = d.select("doc_id", F.when(F.col("doc_id") % 11 > 0, key(40)).alias("key"), (F.col("n_chars") % 7).alias("n_chars"))
    chat = d.filter("doc_id % 5 = 0").select(F.when(F.col("doc_id") % 13 > 0, key(50)).alias("key"), F.lit("chat").alias("kind"), F.concat(F.lit("c"), "doc_id").alias("path"), (F.col("doc_id") % 7).alias("n_chars"))
    disk = d.filter("doc_id % 3 = 0").select(key(60).alias("key"), F.lit("disk").alias("kind"), F.concat(F.lit("d"), "doc_id").alias("path"), (F.col("n_chars") % 7).alias("n_chars"))
    return L.resolve_copy(rows, chat.union(disk), "key", "n_chars")


@query(
    f"""SELECT doc_id, CASE WHEN a IS NOT NULL THEN 'h' WHEN b IS NOT NULL THEN 'len' END AS known_by, coalesce(a, b) AS known_label FROM {DOCS} LEFT JOIN (SELECT h, min('copy of ' || source) AS a FROM {DOCS} WHERE doc_id % 4 = 0 GROUP BY h) USING (h)
    LEFT JOIN (SELECT length(text) AS len, 'item ' || min(lpad(CAST(item_id AS VARCHAR), 6, '0')) AS b FROM benchmark GROUP BY 1) USING (len)"""
)
def known_lookup(spark, sf_dir):
    d = docs(spark, sf_dir)
    hashes = d.filter("doc_id % 4 = 0").select("h", F.concat(F.lit("copy of "), "source").alias("label"))
    sizes = table(spark, sf_dir, "benchmark").select(F.length("text").cast("long").alias("len"), F.concat(F.lit("item "), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("label"))
    return L.known_lookup(d, [("h", hashes), ("len", sizes)]).select("doc_id", "known_by", "known_label")


@query("SELECT doc_id, count(*) AS hits FROM (SELECT DISTINCT doc_id, unnest([source, lang, CAST(n_chars % 50 AS VARCHAR)]) AS key FROM documents) WHERE key IN ('src3', 'es', '7', '8') GROUP BY 1")
def requisite_blacklist(spark, sf_dir):
    keyed = docs(spark, sf_dir).select("doc_id", F.array("source", "lang", (F.col("n_chars") % 50).cast("string")).alias("keys"))
    return L.requisite_blacklist(keyed, "doc_id", "keys", spark.createDataFrame([("src3",), ("es",), ("7",), ("8",)], "key string"))


SIGHTINGS = "(SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE '' END AS f, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS s FROM orders)"


@query(
    f"""SELECT a.o_orderkey, a.id IS NOT NULL AND a.s IS NOT NULL AND a.f <> '' AND EXISTS (SELECT 1 FROM {SIGHTINGS} b WHERE b.id = a.id AND b.o_orderkey < a.o_orderkey AND b.s <> a.s AND b.f <> a.f AND b.f <> '') AS conflict FROM {SIGHTINGS} a"""
)
def identity_conflict(spark, sf_dir):
    """Orders as sightings: ids that are null, files that repeat under several signatures or are empty, signatures that are null."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")).alias("id"), F.when(key % 11 > 0, (key % 3).cast("string")).otherwise("").alias("f"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("s"))
    return L.identity_conflict(rows, "id", "f", "s", ["o_orderkey"]).select("o_orderkey", "conflict")


@query(
    """SELECT o_custkey, concat_ws(',', CASE WHEN s > 1 THEN 'o_orderstatus' END, CASE WHEN p > 1 THEN 'o_orderpriority' END) AS fields FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) WHERE n > 1 AND (s > 1 OR p > 1)"""
)
def field_conflicts(spark, sf_dir):
    return L.field_conflicts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(
    f"""SELECT f, id, differing FROM (SELECT a.f, a.id, concat_ws(',', CASE WHEN bool_or(b.s <> a.s) THEN 's' END, CASE WHEN bool_or(b.p <> a.p) THEN 'p' END) AS differing, row_number() OVER (PARTITION BY a.f ORDER BY a.o_orderkey) AS r
    FROM {{x}} a JOIN {{x}} b ON b.id = a.id AND b.o_orderkey < a.o_orderkey AND b.f <> a.f WHERE a.f <> '' AND b.f <> '' AND (a.s IS NOT NULL OR a.p IS NOT NULL) AND (b.s IS NOT NULL OR b.p IS NOT NULL) GROUP BY a.f, a.id, a.o_orderkey) WHERE r = 1""".format(
        x="(SELECT *, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 2 END AS p FROM (SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 900 AS VARCHAR) ELSE '' END AS f, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS s FROM orders))"
    )
)
def weak_match_once(spark, sf_dir):
    """Orders as sightings: ids, files and fields that are null or empty, files of several rows."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")).alias("id"), F.when(key % 11 > 0, (key % 900).cast("string")).otherwise("").alias("f"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("s"), F.when(key % 4 > 0, key % 2).alias("p"))
    return L.weak_match_once(rows, "id", "f", ["s", "p"], ["o_orderkey"])


@query(
    """SELECT event_id, row_number() OVER w AS use_no, first_value(ts) OVER w AS first_time, coalesce(min(user_id) OVER b <> user_id OR max(user_id) OVER b <> user_id, false) AS by_other FROM
    (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL AND k <> '' WINDOW w AS (PARTITION BY k ORDER BY ts, event_id), b AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def email_reuse(spark, sf_dir):
    return L.email_reuse(submissions(spark, sf_dir), "k", "user_id", ORDER, "ts").select("event_id", "use_no", "first_time", "by_other")


STEMS = "(SELECT o_orderpriority AS stem, o_custkey % 100 AS tail, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE {w})"


@query(
    f"""SELECT o_orderkey FROM {STEMS.format(w="o_orderkey % 40 <> 0")} a WHERE stem IN (SELECT stem FROM {STEMS.format(w="o_orderkey % 40 = 0")}) AND (stem, tail) NOT IN (SELECT (stem, tail) FROM {STEMS.format(w="o_orderkey % 40 = 0")}) AND (stem, d) NOT IN (SELECT (stem, d) FROM {STEMS.format(w="o_orderkey % 40 = 0")})"""
)
def stem_reuse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stem"), (F.col("o_custkey") % 100).alias("tail"), F.col("o_orderkey"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    return L.stem_reuse(o.filter("o_orderkey % 40 != 0"), "o_orderkey", "stem", "tail", "id", "d", o.filter("o_orderkey % 40 = 0"))


ALLOWED = "(SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 = 0)"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lo = hi THEN lo END AS owner FROM lineitem l LEFT JOIN (SELECT l_suppkey, l_linenumber, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM {ALLOWED} GROUP BY 1, 2) USING (l_suppkey, l_linenumber)
    WHERE (l_returnflag, l_suppkey, l_linenumber) NOT IN (SELECT (l_returnflag, l_suppkey, l_linenumber) FROM {ALLOWED})"""
)
def linked_tuple(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey")
    allowed = rows.filter("l_orderkey % 50 = 0").select("l_returnflag", "l_suppkey", "l_linenumber").distinct()
    return L.linked_tuple(rows, "l_returnflag", ["l_suppkey", "l_linenumber"], allowed).select("l_orderkey", "l_linenumber", "l_partkey", "owner")


PARTS = "(SELECT DISTINCT l_orderkey, l_linenumber AS part, l_suppkey % 10 AS h FROM lineitem WHERE {w})"


@query(
    f"""SELECT l_orderkey, ref, shared, total FROM (SELECT a.l_orderkey, r.l_orderkey AS ref, count(*) AS shared FROM {PARTS.format(w="l_orderkey % 100 <> 0")} a JOIN {PARTS.format(w="l_orderkey % 100 = 0")} r USING (part, h) GROUP BY 1, 2)
    JOIN (SELECT l_orderkey AS ref, count(*) AS total FROM {PARTS.format(w="l_orderkey % 100 = 0")} GROUP BY 1) USING (ref) JOIN (SELECT l_orderkey, count(*) AS own FROM {PARTS.format(w="l_orderkey % 100 <> 0")} GROUP BY 1) USING (l_orderkey) WHERE shared >= total - 1 AND total > 5 AND (shared < total OR shared < own)"""
)
def shell_overlap(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), (F.col("l_suppkey") % 10).alias("h"))
    registry = parts.filter("l_orderkey % 100 = 0").withColumnRenamed("l_orderkey", "ref")
    return L.shell_overlap(parts.filter("l_orderkey % 100 != 0"), registry, "l_orderkey", "ref", "part", "h", least=6)


@query("SELECT o_custkey, o_orderpriority, concat_ws(',', CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' END) AS fields FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) > 1 AND count(DISTINCT o_orderstatus) > 1")
def latent_revision(spark, sf_dir):
    return L.latent_revision(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderpriority"], ["o_orderstatus"])


@query(f"SELECT doc_id, 'n' AS field, CAST(n_chars AS VARCHAR) AS a, CAST(len - doc_id % 2 AS VARCHAR) AS b FROM {DOCS} WHERE n_chars <> len - doc_id % 2")
def parser_parity(spark, sf_dir):
    d = docs(spark, sf_dir)
    a = d.select("doc_id", F.lit("n").alias("field"), F.col("n_chars").cast("string").alias("value"))
    b = d.select("doc_id", F.lit("n").alias("field"), (F.col("len") - F.col("doc_id") % 2).cast("string").alias("value"))
    return L.parser_parity(a, b, "doc_id", "field", "value")


@query("SELECT user_id, event_type, count(*) AS sightings, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-04') GROUP BY 1, 2")
def novelty_observe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return L.novelty_observe(e, ["user_id", "event_type"], "ts", e.filter(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).select("user_id", "event_type").distinct())


WHOLES = "(SELECT l_orderkey, sha256(string_agg(DISTINCT CAST(l_suppkey % 20 AS VARCHAR), '|' ORDER BY CAST(l_suppkey % 20 AS VARCHAR))) AS whole, bool_and(l_suppkey % 20 < 16) AS ok FROM lineitem GROUP BY 1)"


@query(f"SELECT l_orderkey, whole FROM {WHOLES} WHERE ok AND whole NOT IN (SELECT whole FROM {WHOLES} WHERE l_orderkey % 2 = 0)")
def parts_known_whole_unknown(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 20).alias("part"))
    pool = parts.filter("part < 16").select("part").distinct()
    wholes = parts.filter("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("part").cast("string"))), "|"), 256).alias("whole")).select("whole").distinct()
    return L.parts_known_whole_unknown(parts, "l_orderkey", "part", pool, wholes)


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = f) AS matches, count(*) AS n FROM lineitem JOIN (VALUES (1, 'N'), (2, 'R'), (3, 'A')) e(l_linenumber, f) USING (l_linenumber) GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = f) > 0 AND count(*) FILTER (WHERE l_returnflag = f) < count(*)")
def partial_replacement(spark, sf_dir):
    expected = spark.createDataFrame([(1, "N"), (2, "R"), (3, "A")], "l_linenumber long, l_returnflag string")
    return L.partial_replacement(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), expected, "l_orderkey", "l_linenumber", "l_returnflag")


NEAREST = "SELECT doc_id, min_by(template, (d, template)) AS template, min(d) AS distance FROM (SELECT doc_id, CAST(item_id AS VARCHAR) AS template, CAST(abs(n_chars - length(b.text)) AS DOUBLE) AS d FROM documents JOIN benchmark b ON abs(n_chars - length(b.text)) <= 5) GROUP BY 1"


@query(NEAREST)
def nearest_template(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("template"), F.length("text").alias("at"))
    return L.nearest_template(docs(spark, sf_dir), "doc_id", "n_chars", t, tol=5)


@query(
    f"""SELECT doc_id, template, concat_ws(',', CASE WHEN n_chars < length(b.text) - 2 OR n_chars > length(b.text) + 2 THEN 'n_chars' END, CASE WHEN item_id % 2 = 0 AND lang NOT IN ('en', 'de') THEN 'lang' END) AS breaks
    FROM documents LEFT JOIN ({NEAREST}) USING (doc_id) LEFT JOIN benchmark b ON template = CAST(item_id AS VARCHAR)"""
)
def template_check(spark, sf_dir):
    n, langs = F.length("text"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array().cast("array<string>"))
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("template"), n.alias("at"), (n - 2).alias("n_chars_lo"), (n + 2).alias("n_chars_hi"), langs.alias("lang_modes"))
    return L.template_check(docs(spark, sf_dir), "doc_id", "n_chars", t, tol=5, ranges=["n_chars"], modes=["lang"]).withColumn("breaks", F.array_join("breaks", ","))


BOXES = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity) AS BIGINT) AS x0, l_partkey % 40 AS y0 FROM lineitem)"


@query(f"SELECT l_orderkey, a.l_linenumber AS a_line, a.l_partkey AS a_part, b.l_linenumber AS b_line, b.l_partkey AS b_part FROM {BOXES} a JOIN {BOXES} b USING (l_orderkey) WHERE (a.l_linenumber, a.l_partkey, a.x0) < (b.l_linenumber, b.l_partkey, b.x0) AND abs(a.x0 - b.x0) < 4 AND abs(a.y0 - b.y0) < 4")
def overlap_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity").cast("long").alias("x0"), (F.col("l_partkey") % 40).alias("y0")).distinct()
    b = b.withColumn("x1", F.col("x0") + 4).withColumn("y1", F.col("y0") + 4)
    out = L.overlap_pairs(b, "l_orderkey", ["l_linenumber", "l_partkey", "x0"], "x0", "x1", "y0", "y1")
    return out.select("l_orderkey", F.col("a.l_linenumber").alias("a_line"), F.col("a.l_partkey").alias("a_part"), F.col("b.l_linenumber").alias("b_line"), F.col("b.l_partkey").alias("b_part"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity + 4 > l_orderkey % 20 + 31 AND l_quantity + l_suppkey % 7 > l_orderkey % 20 + 31")
def right_overflow(spark, sf_dir):
    """Boxes measured twice, on pages of 30 to 49 units with one to spare."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + 4).alias("x1"), (F.col("l_quantity") + F.col("l_suppkey") % 7).alias("second"))
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().withColumn("right", F.col("l_orderkey") % 20 + 30)
    return L.right_overflow(b, "l_orderkey", ["l_linenumber", "l_partkey"], "x1", "second", pages, "right", tol=1)


@query(
    f"""SELECT doc_id, CASE WHEN f <> doc_id THEN f WHEN g <> doc_id THEN g END AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS f, first_value(doc_id) OVER (PARTITION BY source || ':' || len ORDER BY doc_id) AS g FROM {DOCS})"""
)
def dedup_two_keys(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("ident", F.concat_ws(":", "source", "len"))
    return L.dedup_two_keys(d, "h", "ident", ["doc_id"], "doc_id").select("doc_id", "duplicate_of")


@query("SELECT user_id, checks, last, c_name FROM (SELECT user_id, count(*) AS checks, max(ts) AS last FROM events WHERE CAST(ts AS DATE) = '2024-01-15' GROUP BY 1) LEFT JOIN customer ON c_custkey = user_id ORDER BY last DESC, user_id LIMIT 10")
def users_today(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return L.users_today(users, table(spark, sf_dir, "events"), "user_id", "ts", "c_name", day="2024-01-15", k=10)


@query("SELECT user_id FROM events UNION SELECT o_custkey FROM orders")
def all_participants(spark, sf_dir):
    return L.all_participants(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id"), "user_id")


@query("SELECT l_orderkey, l_suppkey, CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' ELSE 'R' END AS only FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_returnflag = 'N') <> bool_or(l_returnflag = 'R')")
def closure_diff(spark, sf_dir):
    return L.closure_diff(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag", left="N", right="R")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_rows(spark, sf_dir):
    return L.recent_rows(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), [F.desc("ts"), F.desc("event_id")], 50)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def multi_key_rank(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return L.multi_key_rank(n, [F.desc("n"), F.col("l_returnflag"), F.col("l_linestatus")])


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def retain_last_n(spark, sf_dir):
    return L.retain_last_n(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.desc("event_id")], 10, partition=["user_id"]).drop("ts")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) WHERE r <= 5")
def retain_ttl_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return L.retain_ttl_cap(e, "ts", now="2024-01-30", days=7, cap=5, partition=["user_id"], order=[F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(f"SELECT DISTINCT h, len FROM {DOCS}")
def collapse_exact(spark, sf_dir):
    return L.collapse_exact(docs(spark, sf_dir).select("h", "len"), ["h", "len"])
