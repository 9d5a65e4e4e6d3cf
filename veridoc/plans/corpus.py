"""Corpus queries: documents and labels as the trusted corpus, lineitem and orders as parts and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.operators import corpus as C
from veridoc.plans.history import SUBMISSIONS, submissions
from veridoc.plans.registry import query, table
from veridoc.plans.verdicts import FLAGS, flags


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("h"), F.length("text").cast("long").alias("len"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))


DOCS = "(SELECT doc_id, lang, source, n_chars, md5(text) AS h, length(text) AS len, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents)"


def labelled(spark, sf_dir):
    verdict = F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("verdict", verdict)


LABELLED = f"(SELECT d.*, quality, toxic, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {DOCS} d JOIN labels USING (doc_id))"


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'PASS') AS passes, count(*) FILTER (WHERE verdict = 'FAIL') AS fails, count(*) FILTER (WHERE h IS NULL) AS missing, count(*) FILTER (WHERE n_chars >= 30) AS reliable, count(DISTINCT h) AS distinct_hashes FROM {LABELLED}")
def corpus_summary(spark, sf_dir):
    return C.corpus_summary(labelled(spark, sf_dir), verdict="verdict", hash_col="h", reliable=F.col("n_chars") >= 30)


@query(
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM {SUBMISSIONS}), g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS passes, count(*) FILTER (WHERE verdict = 'FAIL') AS fails FROM e WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT verdict) > 1)
    SELECT user_id, n, passes, fails, i // 25 AS chunk_no, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS events FROM e JOIN g USING (user_id) GROUP BY ALL"""
)
def contradiction_groups(spark, sf_dir):
    return C.contradiction_groups(submissions(spark, sf_dir), "user_id", "verdict", "event_id", chunk=25)


@query(f"SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passes, count(*) FILTER (WHERE quality <> 1) AS fails, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS pass_rate FROM {LABELLED} GROUP BY 1")
def pass_rate_by(spark, sf_dir):
    return C.pass_rate_by(labelled(spark, sf_dir), "source", F.col("quality") == 1)


EDGES = (0, 100, 500, 1000, 2000, 5000, 20000)


@query(
    "SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS passes FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in zip(EDGES, EDGES[1:])) + f") e(lo, hi) JOIN {LABELLED} ON n_chars > lo AND n_chars <= hi GROUP BY 1, 2"
)
def numeric_bins(spark, sf_dir):
    return C.numeric_bins(labelled(spark, sf_dir), "n_chars", EDGES, F.col("quality") == 1)


@query(
    f"""SELECT h, any_value(n) AS n, i // 3 AS chunk_no, string_agg(substr(verdict, 1, 1), '' ORDER BY i) AS verdicts FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id) - 1 AS i FROM {LABELLED} WHERE h IS NOT NULL) WHERE n >= 2 GROUP BY h, i // 3"""
)
def duplicate_sequences(spark, sf_dir):
    return C.duplicate_sequences(labelled(spark, sf_dir), "h", "verdict", ["doc_id"], chunk=3)


@query(f"SELECT h, min(verdict) AS verdict FROM {LABELLED} GROUP BY 1 HAVING count(DISTINCT verdict) = 1")
def one_label_per_doc(spark, sf_dir):
    return C.one_label_per_doc(labelled(spark, sf_dir), "h", "verdict")


@query(
    f"""SELECT code, support, round(hits / support, 6) AS fail_rate_with, round((fails - hits) / nullif(n - support, 0), 6) AS fail_rate_without, round(hits / support - (fails - hits) / nullif(n - support, 0), 6) AS delta,
      round((hits + 0.5) * (n - support - fails + hits + 0.5) / ((support - hits + 0.5) * (fails - hits + 0.5)), 6) AS odds_ratio, (support = hits AND fails = hits) OR (hits = 0 AND n - support - fails + hits = 0) AS separates
    FROM (SELECT code, CAST(count(*) AS DOUBLE) AS s, count(*) AS support, count(*) FILTER (WHERE quality = 0) AS hits FROM (SELECT DISTINCT doc_id, code FROM {FLAGS}) JOIN labels USING (doc_id) GROUP BY 1), (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0) AS fails FROM labels) WHERE support >= 3"""
)
def rule_ranking(spark, sf_dir):
    return C.rule_ranking(table(spark, sf_dir, "labels"), flags(spark, sf_dir), doc="doc_id", failed=F.col("quality") == 0)


SCORED = f"(SELECT quality AS y, round(1.0 / (1 + breaks), 4) AS s FROM {LABELLED})"


@query(
    f"""WITH b AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM {SCORED} GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM b),
    t AS (SELECT CAST(sum(p) AS BIGINT) AS pp, CAST(sum(n) AS BIGINT) AS nn, CAST(sum(CASE WHEN s >= 0.5 THEN p ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s >= 0.5 THEN n ELSE 0 END) AS BIGINT) AS fp, sum(n * (tp - p / 2)) AS auc, sum(p * tp / (tp + fp)) AS ap FROM c)
    SELECT tp, fp, pp - tp AS fn, nn - fp AS tn, round((tp + nn - fp) / (pp + nn), 6) AS accuracy, round((tp / pp + (nn - fp) / nn) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall,
      round(2 * tp / (2 * tp + fp + pp - tp), 6) AS f1, round(auc / (pp * nn), 6) AS auc, round(ap / pp, 6) AS average_precision, round(greatest(pp, nn) / (pp + nn), 6) AS majority FROM t"""
)
def binary_metrics(spark, sf_dir):
    scored = labelled(spark, sf_dir).select(F.col("quality").alias("y"), F.round(1.0 / (1 + F.col("breaks")), 4).alias("s"))
    return C.binary_metrics(scored, "y", "s")


METRICS = ("len", "breaks")
TRUSTED = f"(SELECT * FROM {LABELLED} WHERE quality = 1)"
LONG = lambda t: "(" + " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {t}" for m in METRICS) + ")"


@query(f"SELECT lang, source, metric, greatest(0.0, min(value) - 5) AS lo, max(value) + 5 AS hi FROM {LONG(TRUSTED)} GROUP BY 1, 2, 3")
def build_envelopes(spark, sf_dir):
    return C.build_envelopes(labelled(spark, sf_dir).filter("quality = 1"), ["lang", "source"], METRICS, pad=5)


ENVELOPES = f"(SELECT lang, source, metric, greatest(0.0, min(value)) AS lo, max(value) AS hi FROM {LONG(TRUSTED)} WHERE source < 'src15' GROUP BY 1, 2, 3)"
GLOBAL = f"(SELECT lang, metric, greatest(0.0, min(value)) AS lo, max(value) AS hi FROM {LONG(TRUSTED)} WHERE lang <> 'es' GROUP BY 1, 2)"


@query(f"SELECT doc_id, metric, value, coalesce(e.lo, g.lo) AS lo, coalesce(e.hi, g.hi) AS hi FROM {LONG(DOCS)} d LEFT JOIN {ENVELOPES} e USING (lang, source, metric) LEFT JOIN {GLOBAL} g USING (lang, metric) WHERE NOT value BETWEEN coalesce(e.lo, g.lo) AND coalesce(e.hi, g.hi)")
def envelope_check(spark, sf_dir):
    good = labelled(spark, sf_dir).filter("quality = 1")
    own = C.build_envelopes(good.filter("source < 'src15'"), ["lang", "source"], METRICS)
    any_source = C.build_envelopes(good.filter("lang <> 'es'"), ["lang"], METRICS).withColumn("source", F.lit(None).cast("string"))
    envelopes = own.unionByName(any_source).withColumnsRenamed({"lang": "bank", "source": "channel"})
    return C.envelope_check(docs(spark, sf_dir), "doc_id", "lang", "source", METRICS, envelopes)


@query(
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY value) - 1 AS i FROM (SELECT DISTINCT source, 'langs' AS name, lang AS value FROM {DOCS} UNION SELECT DISTINCT source, 'sizes', CAST(len % 90 AS VARCHAR) FROM {DOCS}) WHERE value IS NOT NULL)
    SELECT source, n, breaks, name, i // 20 AS chunk_no, string_agg(value, ',' ORDER BY i) AS values FROM (SELECT source, count(*) AS n, CAST(sum(breaks) AS BIGINT) AS breaks FROM {DOCS} GROUP BY 1) JOIN v USING (source) GROUP BY ALL"""
)
def build_profiles(spark, sf_dir):
    return C.build_profiles(docs(spark, sf_dir).withColumn("size", F.col("len") % 90), "source", sets={"langs": "lang", "sizes": "size"}, sums={"breaks": "breaks"}, chunk=20)


POOLS = "(" + " UNION ALL ".join(f"SELECT p_brand, '{m}' AS layer, CAST({m} AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 0" for m in ("p_type", "p_container", "p_size")) + ")"


@query(f"SELECT lang, layer, value, count(*) AS n FROM ({' UNION ALL '.join(f'''SELECT lang, '{m}' AS layer, CAST({m} AS VARCHAR) AS value FROM {TRUSTED}''' for m in ('h', 'breaks', 'source'))}) WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def build_pools(spark, sf_dir):
    return C.build_pools(labelled(spark, sf_dir).filter("quality = 1"), "lang", ["h", "breaks", "source"])


POOLED = lambda t: "(" + " UNION ALL ".join(f"SELECT doc_id, lang, '{m}' AS layer, CAST({m} AS VARCHAR) AS value FROM {t}" for m in ("h", "breaks", "len")) + ")"


@query(f"SELECT *, doc_id IN (SELECT d.doc_id FROM {DOCS} d JOIN {TRUSTED} t ON (d.lang, d.h, d.breaks, d.len) IS NOT DISTINCT FROM (t.lang, t.h, t.breaks, t.len)) AS whole_known FROM (SELECT doc_id, count(*) FILTER (WHERE NOT known) AS unknown_layers, bool_and(NOT known) AS all_unknown FROM (SELECT doc_id, (lang, layer, value) IN (SELECT (lang, layer, value) FROM {POOLED(TRUSTED)}) AS known FROM {POOLED(DOCS)}) GROUP BY 1)")
def pool_membership(spark, sf_dir):
    layers, trusted = ["h", "breaks", "len"], labelled(spark, sf_dir).filter("quality = 1")
    return C.pool_membership(docs(spark, sf_dir), "doc_id", "lang", layers, C.build_pools(trusted, "lang", layers), trusted)


ITEMS = "(SELECT l_orderkey, l_shipmode AS font, CAST(l_linenumber AS VARCHAR) AS chr, CAST(CAST(round(l_quantity) AS BIGINT) % 7 AS VARCHAR) AS hash FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))"


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("font"), F.col("l_linenumber").cast("string").alias("chr"), (F.round("l_quantity").cast("long") % 7).cast("string").alias("hash"))


LIBRARY = f"(SELECT font, chr, list_sort(list(DISTINCT hash)) AS hashes FROM {ITEMS} WHERE l_orderkey % 50 = 0 AND hash < '4' GROUP BY 1, 2)"


@query("SELECT font, chr, array_to_string(hashes, ',') AS hashes FROM " + LIBRARY.replace(" WHERE l_orderkey % 50 = 0 AND hash < '4'", ""))
def build_library(spark, sf_dir):
    return C.build_library(items(spark, sf_dir), "font", "chr", "hash").withColumn("hashes", F.array_join("hashes", ","))


@query(
    f"""SELECT *, (compared >= 2 AND unknown >= 1 AND unknown / greatest(compared, 1) >= 0.5) OR (thin_compared >= 2 AND thin_unknown >= 2 AND thin_unknown / greatest(thin_compared, 1) >= 0.7) AS drift FROM (SELECT l_orderkey, count(*) FILTER (WHERE font = 'N') AS compared, count(*) FILTER (WHERE font = 'N' AND bad) AS unknown,
    count(*) FILTER (WHERE font <> 'N') AS thin_compared, count(*) FILTER (WHERE font <> 'N' AND bad) AS thin_unknown FROM (SELECT *, NOT list_contains(hashes, hash) AS bad FROM {ITEMS} JOIN {LIBRARY} USING (font, chr)) GROUP BY 1)"""
)
def library_drift(spark, sf_dir):
    """The library's samples of N are many, those of A and of all others few."""
    library = C.build_library(items(spark, sf_dir).filter("l_orderkey % 50 = 0 and hash < '4'"), "font", "chr", "hash")
    samples = items(spark, sf_dir).filter("font <> 'R'").groupBy("font").agg(F.when(F.col("font") == "N", 20).otherwise(3).alias("samples"))
    return C.library_drift(items(spark, sf_dir), "l_orderkey", "font", "chr", "hash", library, min_n=2, min_bad=1, ratio=0.5, strict=(2, 2, 0.7), samples=samples, min_samples=5)


@query(f"SELECT k.l_orderkey, f.font FROM (SELECT DISTINCT l_orderkey FROM {ITEMS}) k, (SELECT DISTINCT font FROM {LIBRARY}) f WHERE (k.l_orderkey, f.font) NOT IN (SELECT (l_orderkey, font) FROM {ITEMS})")
def missing_fonts(spark, sf_dir):
    library = C.build_library(items(spark, sf_dir).filter("l_orderkey % 50 = 0 and hash < '4'"), "font", "chr", "hash")
    return C.missing_fonts(items(spark, sf_dir), "l_orderkey", "font", library)


EPOCHS = "(SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(*) AS samples, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates FROM orders WHERE {where} GROUP BY 1)"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(EPOCHS.format(where="true")[1:-1])
def build_epochs(spark, sf_dir):
    return C.build_epochs(orders(spark, sf_dir), "o_orderpriority", "o_orderdate")


IN_EPOCH = "(year(o_orderdate) = 1995 AND o_orderpriority <> '1-URGENT') OR (o_orderpriority = '5-LOW' AND year(o_orderdate) = 1997)"


@query(
    f"""SELECT o_orderkey, CASE WHEN samples >= 5 AND first_date - CAST(o_orderdate AS DATE) >= 14 AND first_date - (CAST(o_orderdate AS DATE) - CAST(o_custkey % 30 AS INT)) >= 14 THEN 'early'
      WHEN CAST(o_orderdate AS DATE) - last_date > 21 AND CAST(o_orderdate AS DATE) - CAST(o_custkey % 30 AS INT) - last_date > 21 AND last_date + 21 <= (SELECT max(last_date) FROM {EPOCHS.format(where=IN_EPOCH)}) THEN 'late' ELSE 'inside' END AS epoch
    FROM orders JOIN {EPOCHS.format(where=IN_EPOCH)} USING (o_orderpriority)"""
)
def profile_epoch(spark, sf_dir):
    o = orders(spark, sf_dir)
    rows = o.withColumn("doc_date", F.date_sub("o_orderdate", (F.col("o_custkey") % 30).cast("int")))
    return C.profile_epoch(rows, "o_orderkey", "o_orderpriority", "o_orderdate", "doc_date", C.build_epochs(o.filter(IN_EPOCH), "o_orderpriority", "o_orderdate"))


@query(f"SELECT DISTINCT lang, h FROM {LABELLED} WHERE quality = 1 OR doc_id % 2 = 0")
def enroll_original(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("lang", "h", "quality", "doc_id")
    return C.enroll_original(rows.filter("doc_id % 2 = 0"), rows.filter("quality = 1").select("lang", "h").distinct(), ["lang", "h"])


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def learn_dependencies(spark, sf_dir):
    return C.learn_dependencies(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


KNOWN = "(SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_partkey % 3 = 0)"


@query(f"SELECT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM {KNOWN}) AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM {KNOWN})")
def dependency_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    return C.dependency_check(rows.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", rows.filter("l_orderkey % 10 = 0 and l_partkey % 3 = 0").select("l_partkey", "l_suppkey"))


CANON = "(SELECT min(l_suppkey) AS l_suppkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_linenumber, l_partkey HAVING count(DISTINCT l_suppkey) = 1)"


@query(CANON[1:-1])
def build_slot_canon(spark, sf_dir):
    return C.build_slot_canon(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'"), "l_suppkey", "l_linenumber", "l_partkey")


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, c.l_suppkey AS canon_owner, (l.l_suppkey, l_linenumber) IN (SELECT (l_suppkey, l_linenumber) FROM {CANON}) AS displaced FROM lineitem l JOIN {CANON} c USING (l_linenumber, l_partkey) WHERE l.l_returnflag <> 'N' AND l.l_suppkey <> c.l_suppkey")
def slot_transplant(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    canon = C.build_slot_canon(rows.filter("l_returnflag = 'N'"), "l_suppkey", "l_linenumber", "l_partkey")
    return C.slot_transplant(rows.filter("l_returnflag <> 'N'"), "l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", canon)


@query("SELECT l_suppkey, l_orderkey, string_agg(DISTINCT lpad(CAST(l_partkey AS VARCHAR), 8, '0'), ',' ORDER BY lpad(CAST(l_partkey AS VARCHAR), 8, '0')) AS parts FROM lineitem WHERE (l_suppkey, l_orderkey) IN (SELECT (l_suppkey, max(l_orderkey)) FROM lineitem GROUP BY l_suppkey) GROUP BY 1, 2")
def build_registry(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("part"))
    return C.build_registry(parts, "l_suppkey", "l_orderkey", "part")


SLOTS = (("head", 1, 4), ("pair", 5, 2), ("last", 32, 1))


@query(" UNION ALL ".join(f"SELECT '{n}' AS slot, substr(h, {a}, {k}) AS value, count(*) AS n FROM (SELECT DISTINCT h FROM {DOCS}) GROUP BY 2" for n, a, k in SLOTS))
def positional_freq(spark, sf_dir):
    return C.positional_freq(docs(spark, sf_dir), "h", SLOTS, distinct=True)


DAY = "2024-01-15"


@query(
    f"""SELECT (SELECT count(DISTINCT user_id) FROM events) AS users, count(DISTINCT user_id) FILTER (WHERE CAST(ts AS DATE) = '{DAY}') AS active_today, count(*) FILTER (WHERE CAST(ts AS DATE) = '{DAY}') AS checks_today,
    count(*) FILTER (WHERE CAST(ts AS DATE) = '{DAY}' AND verdict = 'FAIL') AS fakes_today, count(*) AS checks_total, count(*) FILTER (WHERE verdict = 'FAIL') AS fakes_total FROM {SUBMISSIONS}"""
)
def usage_kpis(spark, sf_dir):
    s = submissions(spark, sf_dir)
    return C.usage_kpis(s, s, user="user_id", ts="ts", fake=F.col("verdict") == "FAIL", day=DAY)


@query(f"SELECT event_type, count(*) AS checks FROM events WHERE CAST(ts AS DATE) = '{DAY}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def bank_today_top(spark, sf_dir):
    return C.bank_today_top(table(spark, sf_dir, "events"), "event_type", "ts", day=DAY, k=3)


@query(
    """SELECT l_orderkey, pin, count(*) AS members, max(x) - min(x) AS span FROM (SELECT l_orderkey, CAST(round(l_quantity) AS BIGINT) AS x FROM lineitem) JOIN
    (SELECT l_orderkey, xs[CAST(floor(len(xs) / 2) AS INT) + 1] AS pin FROM (SELECT l_orderkey, list_sort(list(CAST(round(l_quantity) AS BIGINT))) AS xs FROM lineitem GROUP BY 1)) USING (l_orderkey) WHERE abs(x - pin) <= 6 GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def cluster_spread(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round("l_quantity").cast("long").alias("x"))
    return C.cluster_spread(rows, "l_orderkey", "x", band=6, min_n=3)


@query(
    """SELECT l_orderkey, count(DISTINCT r) AS residuals, count(DISTINCT r) FILTER (WHERE r NOT IN (0, 4, 8)) AS off_lattice FROM (SELECT l_orderkey, round_even((CAST(round(l_quantity) AS BIGINT) - l_linenumber) / 4.0, 0) * 4 AS r FROM lineitem) GROUP BY 1"""
)
def residual_lattice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round("l_quantity").cast("long").alias("x"), F.col("l_linenumber").alias("pin"))
    return C.residual_lattice(rows, "l_orderkey", "x", "pin", q=4.0, allowed=[0.0, 4.0, 8.0])
