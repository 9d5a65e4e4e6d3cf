"""Flag and verdict queries: rules over `documents`, `labels.quality` 0 as fake."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.operators import verdicts as V
from veridoc.plans.registry import query, table

#: (code, tier or None for the prefix's, group or None for the code's, bank or None for all, kind, predicate, enabled)
RULES = (
    ("A-SYMBOLS", None, None, None, "layout", "text LIKE '%###%'", True),
    ("A-TABLE", None, None, None, "layout", "text LIKE '% | %'", True),
    ("B-SHOUT", "B", "style", None, "text", "text LIKE '%!! %'", True),
    ("B-SHORT", "B", "size", None, "text", "n_chars < 60", True),
    ("B-LONG", "B", "size", None, "text", "n_chars > 8000", True),
    ("B-LONG", "B", "size", "de", "text", "n_chars > 5000", True),
    ("B-NOTICE", "B", "notice", None, "text", "lower(text) LIKE '%license%'", True),
    ("B-UMLAUT", "B", "letters", "fr", "text", "text LIKE '%ü%'", True),
    ("B-SOURCE", "B", "origin", "es", "origin", "source IN ('src1', 'src3')", True),
    ("C-MAIL", None, None, None, "text", "text LIKE '%@%'", True),
    ("STAT-LINES", "STATS", "stats", None, "counts", "length(text) - length(replace(text, chr(10), '')) > 40", True),
    ("ODD", None, None, None, "text", "text LIKE 'E%'", True),
    ("A-DELETED", None, None, None, "layout", "length(text) > 0", False),
    ("B-DELETED", "B", "gone", "en", "layout", "no_such_column = 1", False),
)
FLAGS = "(SELECT DISTINCT doc_id, code FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code FROM documents WHERE {e}" + (f" AND lang = '{b}'" if b else "") for c, _, _, b, _, e, on in RULES if on) + "))"
CATALOG = sorted({(c, t, g) for c, t, g, _, _, _, on in RULES if t and on})
TIERED = (
    "(SELECT doc_id, code, coalesce(CASE code " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t, _ in CATALOG) + " END, nullif(regexp_extract(code, '^([ABC])-', 1), '')) AS tier, coalesce(CASE code "
    + " ".join(f"WHEN '{c}' THEN '{g}'" for c, _, g in CATALOG) + f" END, code) AS grp FROM {FLAGS} WHERE code <> 'ODD')"
)


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def evaluated(spark, sf_dir):
    """All flags, from the rules as a table."""
    return V.rule_eval(docs(spark, sf_dir), "doc_id", spark.createDataFrame(RULES, V.CATALOG), bank="lang")


def flags(spark, sf_dir):
    return evaluated(spark, sf_dir).select("doc_id", "code")


def tiered(spark, sf_dir):
    """The flags that have a tier, from the table or by their prefix."""
    return evaluated(spark, sf_dir).filter("tier is not null").select("doc_id", "code", "tier", "grp")


POLICY = (
    f"""(SELECT d.doc_id, CASE WHEN coalesce(n_a, 0) > 0 OR coalesce(b_groups, 0) >= 2 THEN 'FAKE' ELSE 'CLEAN' END AS verdict, coalesce(n_a, 0) AS n_a, coalesce(b_groups, 0) AS b_groups, coalesce(codes, '') AS codes
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE tier = 'A') AS n_a, count(DISTINCT grp) FILTER (WHERE tier = 'B') AS b_groups, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM {TIERED} GROUP BY 1) USING (doc_id))"""
)


def verdicts(spark, sf_dir):
    return V.policy_verdict(docs(spark, sf_dir), tiered(spark, sf_dir), doc="doc_id")


@query(
    f"SELECT doc_id, code, CASE code " + " ".join(f"WHEN '{c}' THEN '{t or c[0]}'" for c, t in {(c, t) for c, t, *_ in RULES if t or c[1] == "-"}) + " END AS tier, CASE code "
    + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in {(c, g or c) for c, _, g, *_ in RULES}) + " END AS grp, CASE code " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in {(x[0], x[4]) for x in RULES}) + f" END AS kind FROM {FLAGS}"
)
def rule_eval(spark, sf_dir):
    return evaluated(spark, sf_dir)


@query(r"SELECT event_id, regexp_extract('[' || upper(event_type) || '] ' || coalesce(props, ''), '^\s*\[([A-Za-z0-9_-]+)\]', 1) AS code FROM events")
def flag_code(spark, sf_dir):
    said = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.upper("event_type"), F.lit("] "), F.coalesce("props", F.lit(""))).alias("flag"))
    return V.flag_code(said, "flag").select("event_id", "code")


@query(f"SELECT doc_id, code, tier, grp FROM {TIERED}")
def classify_flag(spark, sf_dir):
    return V.classify_flag(flags(spark, sf_dir), spark.createDataFrame(CATALOG, "code string, tier string, grp string"))


@query(
    f"""SELECT doc_id, code, CASE WHEN code IN ('A-TABLE') THEN false WHEN code LIKE 'STAT%' THEN false WHEN code IN ('B-SHOUT', 'STAT-X') THEN true WHEN code LIKE 'A-%' THEN true ELSE lower(code) LIKE '%mail%' END AS evidence FROM {FLAGS}"""
)
def split_forgery_flags(spark, sf_dir):
    return V.split_forgery_flags(flags(spark, sf_dir), deny=["A-TABLE"], deny_prefix=["STAT"], allow=["B-SHOUT", "STAT-X"], allow_prefix=["A-"], phrases=["mail"], detail="code")


@query(f"SELECT CASE WHEN code IN ('STAT-LINES', 'B-LONG') THEN 'stats' ELSE 'evidence' END AS route, code, count(*) AS n FROM {FLAGS} GROUP BY 1, 2")
def route_stats_only(spark, sf_dir):
    return V.route_stats_only(flags(spark, sf_dir), ["STAT-LINES", "B-LONG"]).groupBy("route", "code").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, CASE WHEN regexp_matches(said, '(the|der) ') THEN 'FAIL' WHEN regexp_matches(said, 'que') THEN 'PASS' ELSE 'UNKNOWN' END AS verdict
    FROM (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id)"""
)
def verdict_from_replies(spark, sf_dir):
    return V.verdict_from_replies(table(spark, sf_dir, "conversations"), "conv_id", "text", ["turn"], fail="(the|der) ", passed="que")


@query(
    f"""SELECT doc_id, CASE WHEN raw = 'UNKNOWN' THEN 'UNKNOWN' WHEN n_a > 0 OR score >= 60 OR raw = 'FAKE' THEN 'FAKE' ELSE 'CLEAN' END AS final_verdict,
      CASE WHEN raw = 'UNKNOWN' THEN score WHEN n_a > 0 OR score >= 60 OR raw = 'FAKE' THEN greatest(score, 95) ELSE 0 END AS final_score
    FROM (SELECT doc_id, n_a, b_groups * 30 AS score, CASE WHEN d.lang = 'es' THEN 'UNKNOWN' ELSE 'CLEAN' END AS raw FROM {POLICY} p JOIN documents d USING (doc_id))"""
)
def normalize_verdict(spark, sf_dir):
    rows = verdicts(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").withColumn("score", F.col("b_groups") * 30).withColumn("raw", F.when(F.col("lang") == "es", "UNKNOWN").otherwise("CLEAN"))
    return V.normalize_verdict(rows, verdict="raw", score="score", hard="n_a").select("doc_id", "final_verdict", "final_score")


@query(f"SELECT * FROM {POLICY}")
def policy_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query(f"SELECT source, verdict, count(*) AS n FROM {POLICY} JOIN documents USING (doc_id) GROUP BY 1, 2")
def verdicts_by_source(spark, sf_dir):
    """The flagship: documents, rules, tiers, verdicts, counts by source."""
    return verdicts(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source", "verdict").agg(F.count("*").alias("n"))


POLICIES = [("en", "FAKE", "UNKNOWN", 2), ("de", "FAKE", "FAKE", 1), ("fr", "UNKNOWN", "UNKNOWN", 2)]


@query(
    f"""SELECT doc_id, CASE WHEN n_chars < 20 THEN coalesce(iv, 'FAKE') WHEN source = 'src7' THEN coalesce(wv, 'UNKNOWN') WHEN hard > 0 THEN 'FAKE' WHEN groups >= coalesce(need, 2) THEN 'FAKE' WHEN n_chars % 97 = 0 THEN 'FAKE' ELSE 'CLEAN' END AS verdict,
      CASE WHEN n_chars < 20 THEN 'incomplete' WHEN source = 'src7' THEN 'type' WHEN hard > 0 THEN 'hard' WHEN groups >= coalesce(need, 2) THEN 'groups' WHEN n_chars % 97 = 0 THEN 'conflict' ELSE 'none' END AS reason
    FROM (SELECT d.doc_id, d.n_chars, d.source, coalesce(f.hard, 0) AS hard, coalesce(f.groups, 0) AS groups, p.iv, p.wv, p.need FROM documents d
      LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE tier = 'A') AS hard, count(DISTINCT grp) FILTER (WHERE tier = 'B') AS groups FROM {TIERED} WHERE code <> 'A-TABLE' GROUP BY 1) f USING (doc_id)
      LEFT JOIN (VALUES ('en', 'FAKE', 'UNKNOWN', 2), ('de', 'FAKE', 'FAKE', 1), ('fr', 'UNKNOWN', 'UNKNOWN', 2)) p(lang, iv, wv, need) USING (lang))"""
)
def pipeline_verdict(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", (F.col("n_chars") >= 20).alias("complete"), (F.col("source") != "src7").alias("right_type"), (F.col("n_chars") % 97 == 0).alias("conflict"))
    policy = spark.createDataFrame(POLICIES, "lang string, incomplete_verdict string, wrong_type_verdict string, groups_needed int")
    return V.pipeline_verdict(d, tiered(spark, sf_dir).withColumn("ignored", F.col("code") == "A-TABLE"), policy, doc="doc_id", bank="lang")


COMBOS = {"loud start": ("B-SHOUT", "ODD"), "long mail": ("B-LONG", "C-MAIL"), "long notice": ("B-LONG", "B-NOTICE"), "long lines": ("B-LONG", "STAT-LINES")}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS combo FROM {FLAGS} WHERE code IN {v} GROUP BY doc_id HAVING count(DISTINCT code) = {len(v)}" for k, v in COMBOS.items()))
def k_of_n_evidence(spark, sf_dir):
    return V.k_of_n_evidence(flags(spark, sf_dir), "doc_id", COMBOS)


@query(
    f"""SELECT doc_id, CAST(sum(least(w, coalesce(cap, w))) AS BIGINT) AS score FROM (SELECT doc_id, grp AS category, sum(length(code)) AS w FROM {TIERED} GROUP BY 1, 2)
    LEFT JOIN (VALUES ('size', 5), ('style', 3)) c(category, cap) USING (category) GROUP BY doc_id"""
)
def category_scores(spark, sf_dir):
    caps = spark.createDataFrame([("size", 5), ("style", 3)], "category string, cap long")
    weighted = tiered(spark, sf_dir).select("doc_id", F.col("grp").alias("category"), F.length("code").cast("long").alias("weight"))
    return V.category_scores(weighted, "doc_id", caps)


@query(f"SELECT doc_id, CAST(sum(CASE WHEN code LIKE '%SYM%' THEN 95 WHEN code LIKE '%B-S%' THEN 65 ELSE 50 END) AS BIGINT) AS score FROM {FLAGS} GROUP BY 1")
def flag_score(spark, sf_dir):
    return V.flag_score(flags(spark, sf_dir), "doc_id", [("SYM", 95), ("B-S", 65)])


@query(
    f"""SELECT p.doc_id, CASE WHEN verdict = 'FAKE' AND coalesce(only_d, false) THEN 'CLEAN' ELSE verdict END AS merged, CASE WHEN verdict = 'FAKE' AND coalesce(only_d, false) THEN f.codes ELSE '' END AS suppressed
    FROM {POLICY} p LEFT JOIN (SELECT doc_id, bool_and(code IN ('A-TABLE', 'STAT-LINES')) AS only_d, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM {TIERED} GROUP BY 1) f USING (doc_id)"""
)
def merge_verdicts(spark, sf_dir):
    diagnostic = spark.createDataFrame([("A-TABLE",), ("STAT-LINES",)], "code string")
    return V.merge_verdicts(verdicts(spark, sf_dir), tiered(spark, sf_dir), diagnostic, doc="doc_id")


@query(f"SELECT f.doc_id, f.code FROM {FLAGS} f JOIN documents d USING (doc_id) WHERE (lang, code) IN (('en', 'B-SHOUT'), ('de', 'A-TABLE'), ('fr', 'C-MAIL'))")
def profile_gate(spark, sf_dir):
    enabled = spark.createDataFrame([("en", "B-SHOUT"), ("de", "A-TABLE"), ("fr", "C-MAIL")], "lang string, code string")
    return V.profile_gate(flags(spark, sf_dir), docs(spark, sf_dir), enabled, doc="doc_id", profile="lang").select("doc_id", "code")


REASONS = [("A-SYMBOLS", "filled with symbols"), ("A-TABLE", "a table, not a text"), ("B-SHOUT", "written in capitals"), ("B-SHORT", "odd size"), ("B-LONG", "odd size")]


@query(
    f"""SELECT doc_id, array_to_string(list_slice(list_sort(list(DISTINCT reason)), 1, 2), '; ') AS reasons FROM {FLAGS} JOIN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in REASONS) + ") r(code, reason) USING (code) GROUP BY doc_id"
)
def explain_flags(spark, sf_dir):
    return V.explain_flags(flags(spark, sf_dir), spark.createDataFrame(REASONS, "code string, reason string"), doc="doc_id", limit=2)


@query(
    "SELECT c.code, coalesce(hits, 0) AS hits, coalesce(hits, 0) = 0 AND c.code NOT IN ('ODD') AS safe FROM (VALUES " + ", ".join(f"('{c}')" for c in sorted({x[0] for x in RULES})) + f") c(code) LEFT JOIN (SELECT code, count(DISTINCT doc_id) AS hits FROM {FLAGS} WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1) h USING (code)"
)
def fp_gate(spark, sf_dir):
    catalog = spark.createDataFrame([(x[0],) for x in RULES], "code string")
    return V.fp_gate(catalog, flags(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1"), doc="doc_id", blocked=["ODD"])


@query(
    f"""SELECT legacy, candidate, count(*) AS n, legacy = candidate AS agree FROM (SELECT CASE quality WHEN 1 THEN 'CLEAN' ELSE 'FAKE' END AS legacy, verdict AS candidate FROM labels JOIN {POLICY} USING (doc_id)) GROUP BY 1, 2"""
)
def shadow_agreement(spark, sf_dir):
    legacy = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "CLEAN").otherwise("FAKE").alias("verdict"))
    return V.shadow_agreement(legacy, verdicts(spark, sf_dir), doc="doc_id")


OUTCOME = "CASE event_type WHEN 'purchase' THEN 'caught' WHEN 'error' THEN 'missed' WHEN 'click' THEN 'unknown' ELSE 'error' END"


@query(
    f"""SELECT *, 10 * caught - 10 * missed - 50 * errors AS score FROM (SELECT CAST(ts AS DATE) AS round, count(*) AS scanned, count(*) FILTER (WHERE o = 'caught') AS caught, count(*) FILTER (WHERE o = 'missed') AS missed,
    count(*) FILTER (WHERE o = 'error') AS errors, count(*) FILTER (WHERE o = 'unknown') AS unknown FROM (SELECT ts, {OUTCOME} AS o FROM events) GROUP BY 1)"""
)
def eval_rollup(spark, sf_dir):
    return V.eval_rollup(table(spark, sf_dir, "events").select(F.to_date("ts").alias("round"), F.expr(OUTCOME).alias("outcome")), "round")


@query(f"SELECT d.doc_id, coalesce(n, 0) = 2 AS all_expected FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT code) AS n FROM {FLAGS} WHERE code IN ('B-NOTICE', 'STAT-LINES') GROUP BY 1) USING (doc_id)")
def expected_subset(spark, sf_dir):
    seen = docs(spark, sf_dir).select("doc_id").join(flags(spark, sf_dir), "doc_id", "left").groupBy("doc_id").agg(F.collect_set("code").alias("observed"))
    return V.expected_subset(seen.withColumn("expected", F.array(F.lit("B-NOTICE"), F.lit("STAT-LINES"))), "expected", "observed").select("doc_id", "all_expected")


@query(f"SELECT doc_id, count(*) FILTER (WHERE code IN ('A-TABLE', 'B-SHOUT')) = 0 AS disjoint FROM {FLAGS} GROUP BY doc_id")
def disjoint_names(spark, sf_dir):
    seen = flags(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("code").alias("observed"))
    return V.disjoint_names(seen.withColumn("expected", F.array(F.lit("A-TABLE"), F.lit("B-SHOUT"))), "expected", "observed").select("doc_id", "disjoint")


@query(
    f"""SELECT coalesce(source, 'TOTAL') AS bank, count(*) AS files, count(*) FILTER (WHERE verdict = 'FAKE') AS fakes, CAST(sum(b_groups) AS BIGINT) AS soft_flags FROM {POLICY} JOIN documents USING (doc_id) GROUP BY ROLLUP (source)"""
)
def deep_scan_report(spark, sf_dir):
    rows = verdicts(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return V.deep_scan_report(rows, "source", verdict="verdict", soft="b_groups")
