"""Queries of text, id and classification operators over documents, pages, events, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.operators import text as T
from veridoc.plans.history import submissions
from veridoc.plans.registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, sha256(text) AS text_sha256, substr(sha256(text), 1, 16) AS text_sha16 FROM documents")
def content_hashes(spark, sf_dir):
    return T.content_hashes(docs(spark, sf_dir).select("doc_id", "text"), ["text"]).drop("text")


@query("SELECT sha256(regexp_replace(regexp_replace(regexp_replace(html, '>[^<]+<', '><', 'g'), '=\"[^\"]*\"', '=\"\"', 'g'), '[0-9]+', '0', 'g')) AS skeleton, count(*) AS n FROM pages GROUP BY 1")
def skeleton_hash(spark, sf_dir):
    masks = [(">[^<]+<", "><"), ('="[^"]*"', '=""'), ("[0-9]+", "0")]
    return T.skeleton_hash(table(spark, sf_dir, "pages"), "html", masks).groupBy("skeleton").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, sha256(trim(lower(regexp_replace(regexp_replace(translate(text, chr(160) || chr(8239) || chr(8201) || chr(8199) || '‐‑‒–—−０１２３４５６７８９', '    ------0123456789'), '-[ \t]*\r?\n[ \t]*', '', 'g'), '[ \t\r\n]+', ' ', 'g')))) AS semantic FROM documents")
def semantic_hash(spark, sf_dir):
    return T.semantic_hash(docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


@query(r"SELECT doc_id, sha256(nfc_normalize(translate(regexp_replace(text, '([aeinou])', '\1' || chr(769), 'g'), chr(160) || chr(8239) || chr(8201) || chr(8199) || '‑０１２３４５６７８９', '    ‐0123456789'))) AS normalized FROM documents")
def normalized_text(spark, sf_dir):
    """Texts whose vowels have their marks behind them."""
    marked = F.regexp_replace("text", "([aeinou])", "$1\u0301")
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.normalized(marked), 256).alias("normalized"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":"' || o_custkey || '","o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS signature FROM orders""")
def critical_signature(spark, sf_dir):
    return T.critical_signature(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey", "o_orderpriority"]).select("o_orderkey", "signature")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN sha256(o_custkey || '|' || o_orderstatus) ELSE '' END AS identity FROM orders")
def identity_hash(spark, sf_dir):
    return T.identity_hash(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], F.col("o_totalprice") > 100000).select("o_orderkey", "identity")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || lower(trim(o_orderpriority)) AS txn FROM orders")
def txn_signature(spark, sf_dir):
    return T.txn_signature(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", "o_orderpriority").select("o_orderkey", "txn")


NUMBERS = "(SELECT c_custkey, c_name, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '7') AS phone, repeat(CAST(c_custkey AS VARCHAR), 4) AS card FROM customer)"


@query(f"SELECT c_custkey, concat_ws(';', CASE WHEN length(phone) >= 10 THEN 'phone:' || right(phone, 10) END, CASE WHEN length(card) >= 12 THEN 'card:' || card END, CASE WHEN length(card) >= 16 THEN 'acct:' || card END, CASE WHEN length(card) >= 4 THEN 'acct4:' || right(card, 4) || '|' || lower(trim(c_name)) END) AS keys FROM {NUMBERS}")
def requisite_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lpad((F.col("c_custkey") * 7919).cast("string"), 11, "7").alias("phone"), F.repeat(F.col("c_custkey").cast("string"), 4).alias("card"))
    return T.requisite_keys(c, phone="phone", card="card", account="card", name="c_name").select("c_custkey", F.array_join("keys", ";").alias("keys"))


@query(
    """SELECT doc_id, m AS opid FROM documents LEFT JOIN (SELECT doc_id, m FROM (SELECT doc_id, m, row_number() OVER (PARTITION BY doc_id ORDER BY NOT ends_with(m, '7'), abs(length(m) - 12), -length(m), m) AS r
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{6,}')) AS m FROM documents)) WHERE r = 1) USING (doc_id)"""
)
def extract_opid(spark, sf_dir):
    return T.extract_opid(docs(spark, sf_dir), "text", pattern="[0-9]{6,}", suffix="7", length=12).select("doc_id", "opid")


@query("SELECT doc_id, CASE WHEN any_opid <> '' THEN 'opid:' || any_opid ELSE 'file:' || md5(text) END AS receipt_key FROM (SELECT *, coalesce(nullif(regexp_extract(text, '[0-9]{16}', 0), ''), nullif(regexp_extract(text, '[0-9]{3}-[0-9]{4}', 0), ''), '') AS any_opid FROM documents)")
def receipt_key(spark, sf_dir):
    rows = T.extract_any_opid(docs(spark, sf_dir).withColumn("h", F.md5("text")), "text", ["[0-9]{16}", "[0-9]{3}-[0-9]{4}"])
    return T.receipt_key(rows, "any_opid", "h").select("doc_id", "receipt_key")


LINES = "('Total due: ' || o_orderkey || chr(10) || 'Total' || chr(10) || ' ' || o_orderpriority || chr(10) || 'Payer ' || o_custkey)"


@query(f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS total, CAST(o_custkey AS VARCHAR) AS payer, CAST(NULL AS VARCHAR) AS note FROM (SELECT *, {LINES} AS t FROM orders)")
def label_field_extract(spark, sf_dir):
    lines = F.concat(F.lit("Total due: "), "o_orderkey", F.lit("\nTotal\n "), "o_orderpriority", F.lit("\nPayer "), "o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", lines.alias("t"))
    return T.label_field_extract(rows, "t", {"total": ["Total", "Total due"], "payer": ["Payer"], "note": ["Note"]}).drop("t")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM orders")
def parse_amount(spark, sf_dir):
    """Every price written in four ways, as a phone number and with a date, and read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    english, way = F.format_number("p", 2), F.col("o_orderkey") % 6
    spaced = F.translate(english, ",.", "\u00a0,")
    t = F.when(way == 0, F.concat(F.lit("to pay: "), spaced, F.lit(" ₽"))).when(way == 1, F.concat(F.lit("sum "), english)).when(way == 2, F.translate(english, ",.", ".,"))
    t = t.when(way == 3, F.concat(F.col("p").cast("string"), F.lit(" EUR"))).when(way == 4, F.concat(F.lit("+7 "), spaced)).otherwise(F.concat(F.lit("01.02.2024 "), spaced))
    return T.parse_amount(o.withColumn("t", t), "t").select("o_orderkey", F.col("amount").cast("double").alias("amount"))


@query("SELECT o_orderkey, translate(format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE), ',.', ' ,') AS formatted FROM orders")
def format_amount(spark, sf_dir):
    return T.format_amount(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "formatted")


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '[0-9]{3}-[0-9]{4}'), ''), nullif(regexp_extract(text, '[A-Z][a-z]+'), '')) AS any_opid FROM documents")
def extract_any_opid(spark, sf_dir):
    return T.extract_any_opid(docs(spark, sf_dir), "text", ["[0-9]{3}-[0-9]{4}", "[A-Z][a-z]+"]).select("doc_id", "any_opid")


MONTHS = {m: n for n, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS printed_at FROM events")
def parse_datetimes(spark, sf_dir):
    """Every time written in numbers, behind a label and another date, in words, without seconds, and as no date."""
    way, at = F.col("event_id") % 5, lambda f: F.date_format("ts", f)
    t = F.when(way == 0, F.concat(F.lit("paid on "), at("dd.MM.yyyy HH:mm:ss"), F.lit(" by card")))
    t = t.when(way == 1, F.concat(F.lit("printed 01.02.2003 04:05:06\nDate of payment:\u00a0"), at("dd.MM.yyyy HH:mm:ss")))
    t = t.when(way == 2, F.concat(F.lit("on "), at("d MMMM yyyy, HH:mm:ss"))).when(way == 3, at("dd.MM.yyyy HH:mm")).otherwise("on 31.02.2024 10:00")
    return T.parse_datetimes(table(spark, sf_dir, "events").select("event_id", t.alias("t")), "t", labels=["date of payment"], months=MONTHS).drop("t")


@query("SELECT event_id, epoch_us(date_trunc('second', ts) - INTERVAL 3 HOUR) // 1000000 AS instant FROM events")
def parse_pdf_date(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+03'00'")).alias("t"))
    return T.parse_pdf_date(rows, "t").select("event_id", F.unix_seconds("instant").alias("instant"))


LAYOUT = (("kind", 1, 1), ("day", 2, 3), ("hour", 5, 2), ("minute", 7, 2), ("ref", 9, 8), ("tail", 17, 16))
OPID = "(SELECT event_id, user_id, ts, upper(substr(event_type, 1, 1)) || lpad(CAST(dayofyear(ts) AS VARCHAR), 3, '0') || strftime(ts, '%H%M') || upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 24)) AS id FROM events)"


def opids(spark, sf_dir):
    made = F.concat(F.upper(F.substring("event_type", 1, 1)), F.lpad(F.dayofyear("ts").cast("string"), 3, "0"), F.date_format("ts", "HHmm"), F.upper(F.substring(F.md5(F.col("event_id").cast("string")), 1, 24)))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", made.alias("id"))


@query("SELECT event_id, " + ", ".join(f'substr(id, {a}, {n}) AS "{name}"' for name, a, n in LAYOUT) + f" FROM {OPID}")
def id_decode(spark, sf_dir):
    return T.id_decode(opids(spark, sf_dir), "id", LAYOUT).select("event_id", "parts.*")


GRAMMAR = [("even", "length", 1, 32, "", "LEN"), ("even", "kind", 1, 1, "^[PE]$", "KIND"), ("odd", "ref", 9, 2, "^[0-9]", "REF"), ("odd", "length", 1, 31, "", "LEN")]


@query(
    f"SELECT event_id, 'KIND' AS code FROM {OPID} WHERE user_id % 2 = 0 AND NOT regexp_matches(substr(id, 1, 1), '^[PE]$') UNION ALL SELECT event_id, 'REF' FROM {OPID} WHERE user_id % 2 = 1 AND NOT regexp_matches(substr(id, 9, 2), '^[0-9]') UNION ALL SELECT event_id, 'LEN' FROM {OPID} WHERE user_id % 2 = 1"
)
def id_structure_check(spark, sf_dir):
    rows = opids(spark, sf_dir).withColumn("issuer", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    grammar = spark.createDataFrame(GRAMMAR, "issuer string, slot string, at int, len int, regex string, code string")
    return T.id_structure_check(rows, "event_id", "id", "issuer", grammar)


@query(
    """SELECT event_id, abs(d + (h + 3) // 24 - dayofyear(l)) <= 1 AS day_ok, least(abs((h + 3) % 24 - hour(l)), 24 - abs((h + 3) % 24 - hour(l))) <= 1 AS hour_ok, least(abs(m - minute(l)), 60 - abs(m - minute(l))) <= 5 AS minute_ok
    FROM (SELECT event_id, dayofyear(ts) AS d, hour(ts) AS h, minute(ts) AS m, ts + INTERVAL 3 HOUR + event_id % 40 * INTERVAL 1 MINUTE AS l FROM events)"""
)
def id_time_check(spark, sf_dir):
    parts = T.id_decode(opids(spark, sf_dir), "id", LAYOUT).select("event_id", F.col("parts.day").cast("int").alias("d"), F.col("parts.hour").cast("int").alias("h"), F.col("parts.minute").cast("int").alias("m"), (F.col("ts") + F.make_dt_interval(hours=F.lit(3), mins=(F.col("event_id") % 40).cast("int"))).alias("l"))
    return T.id_time_check(parts, "d", "h", "m", "l").select("event_id", "day_ok", "hour_ok", "minute_ok")


@query(f"SELECT event_id, length(regexp_replace(substr(id, 9, 8), '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(substr(id, 9, 8), '[^A-Za-z]', '', 'g')) > 4 AS dense FROM {OPID}")
def letter_density(spark, sf_dir):
    return T.letter_density(opids(spark, sf_dir), "id", 9, 8, 4).select("event_id", "letters", "dense")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f < a AND t >= a THEN abs(a + f - t) <= 0.05 END AS adds_up FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(round(l_tax * 100) AS DECIMAL(18,2)) AS f,
    CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(l_linenumber AS DECIMAL(18,2)) AS t FROM lineitem)"""
)
def amount_arithmetic(spark, sf_dir):
    a = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), F.round(F.col("l_tax") * 100).cast("decimal(18,2)").alias("f"), (a + F.col("l_linenumber").cast("decimal(18,2)")).alias("t"))
    return T.amount_arithmetic(rows, "a", "f", "t", eps=0.05).select("l_orderkey", "l_linenumber", "l_partkey", "adds_up")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 END AS first_mismatch FROM orders")
def amount_triples(spark, sf_dir):
    """Amount, fee and total twice over, the first total one too large for every third order, the second for every second."""
    p, key = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    one = p + 100 + F.when(key % 3 == 0, 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[x.cast("decimal(18,2)") for x in (p + 90, F.lit(10), one, F.lit(5), one + 5 + F.when(key % 2 == 0, 1).otherwise(0))]).alias("a"))
    return T.amount_triples(rows, "a").select("o_orderkey", "first_mismatch")


@query("SELECT o_orderkey, CAST(o_totalprice >= 1000 AS BIGINT) AS grouped, CAST(o_totalprice >= 1000 AND o_orderkey % 2 = 0 AS BIGINT) AS ungrouped, o_totalprice >= 1000 AND o_orderkey % 2 = 0 AS mixed_grouping, CAST(o_orderkey % 4 >= 2 AS BIGINT) AS padded, (o_orderkey % 3 = 0) <> (o_orderkey % 4 > 0) AS uneven_trail FROM orders")
def amount_typography(spark, sf_dir):
    rows, key, nbsp = T.format_amount(table(spark, sf_dir, "orders"), "o_totalprice"), F.col("o_orderkey"), F.lit("\u00a0")
    plain = F.when(key % 2 == 0, F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))).otherwise("")
    t = F.concat(F.lit("sum: "), "formatted", F.lit(" RUR"), F.repeat(nbsp, (key % 3 == 0).cast("int")), F.lit("\nfee: 10,00 RUR"), F.repeat(nbsp, (key % 4).cast("int")), F.lit("\n ="), plain)
    return T.amount_typography(rows.withColumn("t", t), "t").select("o_orderkey", "grouped", "ungrouped", "mixed_grouping", "padded", "uneven_trail")


@query(
    r"""WITH s AS (SELECT substr('abcdefghijklmnopqrstuvwxyz', a, n) AS s, n FROM range(1, 26) r(a), range(2, 27) q(n) WHERE a + n <= 27),
    l AS (SELECT doc_id, coalesce((SELECT max(n) FROM s WHERE contains(lower(text), s)), 0) AS alphabet_run FROM documents)
    SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(lower(text), '[bcdfghjklmnpqrstvwxz]+'), lambda x: length(x))), 0) AS consonant_run, alphabet_run,
    """
    + " + ".join(f"(length(d) - length(replace(d, '{i}{i + 1}', ''))) // 2" for i in range(9))
    + r""" AS ascending_digits, length(f) = 4 AND f[1] = f[3] AND f[2] = f[4] AND f[1] <> f[2] AS abab_tail, length(regexp_replace(text, '[^\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS control_chars,
    length(text) - length(trim(text, ' ')) AS padding, len(regexp_extract_all(text, 'aaa|eee|###|!!!|\*\*\*|&&&')) AS triples
    FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS d, regexp_extract(text, '([0-9]{4})[^0-9]*$', 1) AS f FROM documents) JOIN l USING (doc_id)"""
)
def text_artifact_scores(spark, sf_dir):
    return T.text_artifact_scores(docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


CARDS = "(SELECT c_custkey, CAST(c_custkey * 7919 % 9000 + 1000 AS VARCHAR) AS a, CAST(c_custkey * 6007 % 9000 + 1000 AS VARCHAR) AS b, c_custkey % 2 = 0 AS two FROM customer)"
KNOWN = "(substr({0}, 1, 1) IN ('4', '5') OR substr({0}, 1, 2) = '22')"


@query(f"SELECT c_custkey, 1 + CAST(two AS BIGINT) AS cards, a AS card_head, '1234' AS card_tail, CASE WHEN two THEN b END AS second_head, CASE WHEN two THEN a END AS second_tail, {KNOWN.format('a')} AND (NOT two OR {KNOWN.format('b')}) AS prefix_ok, two AND a[1] = a[3] AND a[2] = a[4] AND a[1] <> a[2] AS abab_tail FROM {CARDS}")
def card_masks(spark, sf_dir):
    head = lambda n: (F.col("c_custkey") * n % 9000 + 1000).cast("string")
    t = F.concat(F.lit("card "), head(7919), F.lit(" **** 1234 ok"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" to "), head(6007), F.lit("xxxxxxxx"), head(7919))).otherwise(""))
    return T.card_masks(table(spark, sf_dir, "customer").select("c_custkey", t.alias("t")), "t", ["4", "5", "22"]).drop("t")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'))) AS mentions FROM documents")
def distinct_mentions(spark, sf_dir):
    return T.distinct_mentions(docs(spark, sf_dir), "text", "[0-9]{3}-[0-9]{4}").select("doc_id", "mentions")


OUTSIDE = "((o_orderpriority = '1-URGENT' AND {0} < DATE '1995-01-01') OR (o_orderpriority = '5-LOW' AND {0} >= DATE '1994-01-01' AND {0} < DATE '1997-01-01'))"


@query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {OUTSIDE.format('CAST(o_orderdate AS DATE)')} OR (o_orderkey % 4 > 0 AND {OUTSIDE.format('CAST(o_orderdate AS DATE) + 400')})")
def regime_check(spark, sf_dir):
    """Against the day of the order and another 400 days later, which every fourth order lacks."""
    rules = [("1-URGENT", "1995-01-01", None), ("5-LOW", None, "1994-01-01"), ("5-LOW", "1997-01-01", None)]
    regimes = spark.createDataFrame(rules, "token string, f string, t string").select("token", F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"))
    rows = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn("later", F.when(F.col("o_orderkey") % 4 > 0, F.date_add("d", 400)))
    return T.regime_check(rows, "o_orderkey", "o_orderpriority", ["d", "later"], regimes)


@query("SELECT event_id, event_id % 200 > 60 AS edited, event_id % 7 * 60 > 300 AS operation_late, greatest(event_id % 200, event_id % 7 * 60) <= 1 AS clocks_collapse FROM events")
def metadata_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 200)).alias("m"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))).alias("o"))
    return T.metadata_drift(e, "ts", "m", "o").select("event_id", "edited", "operation_late", "clocks_collapse")


@query("SELECT doc_id, length(trim(text, ' ')) < 30 AND n_chars > 0 AS missing_text FROM documents")
def missing_text_layer(spark, sf_dir):
    return T.missing_text_layer(docs(spark, sf_dir), "text", "n_chars").select("doc_id", "missing_text")


MARKERS = (("SCRIPT", "<script", 1), ("NO-END", "<p>", 12), ("HREF", "href=", 4))


@query(" UNION ALL ".join(f"SELECT page_id, '{c}' AS code, len(regexp_extract_all(html, '{p}')) AS n FROM pages WHERE len(regexp_extract_all(html, '{p}')) > {m}" for c, p, m in MARKERS))
def marker_profile(spark, sf_dir):
    return T.marker_profile(table(spark, sf_dir, "pages"), "page_id", "html", MARKERS)


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, count(DISTINCT l_returnflag) > 1 AS mixed FROM lineitem GROUP BY 1")
def mixed_encoding(spark, sf_dir):
    return T.mixed_encoding(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AS well_formed FROM orders")
def number_format(spark, sf_dir):
    n = F.concat(F.lit("R"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("19991399")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return T.number_format(table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")), "n", "^R[0-9]{8}-[0-9]{8}$", date_at=(2, 8, "yyyyMMdd")).drop("n")


@query("SELECT doc_id, 'receipt_' || lang || '.pdf' AS base_name, lang IN ('de', 'en') AS official FROM documents")
def filename_grammar(spark, sf_dir):
    name = F.concat(F.lit("receipt_"), "lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ("), "doc_id", F.lit(")"))).otherwise(""), F.lit(".pdf"))
    return T.filename_grammar(docs(spark, sf_dir).select("doc_id", name.alias("name")), "name", r"^receipt_(de|en)\.pdf$").drop("name")


@query("SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY 1, 2) GROUP BY 1")
def char_entropy(spark, sf_dir):
    return T.char_entropy(docs(spark, sf_dir), "doc_id", "text").withColumn("entropy", F.round("entropy", 6))


@query(
    r"""SELECT *, CASE WHEN host <> registered AND length(host) % 3 = 0 THEN 'own ' || host WHEN length(registered) % 2 = 0 THEN upper(registered) END AS bank
    FROM (SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS registered FROM (SELECT page_id, lower(regexp_extract(url, '(?:@|://)([A-Za-z0-9.-]+)', 1)) AS host FROM pages))"""
)
def domain_functions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = T.domain_functions(pages, "url")
    own = hosts.filter("host <> registered and length(host) % 3 = 0").select(F.col("host").alias("domain"), F.concat(F.lit("own "), "host").alias("bank"))
    banks = own.union(hosts.filter("length(registered) % 2 = 0").select("registered", F.upper("registered"))).distinct()
    return T.domain_functions(pages, "url", banks).select("page_id", "host", "registered", "bank")


HOSTS = "(SELECT page_id, lower(regexp_extract(url, '(?:@|://)([A-Za-z0-9.-]+)', 1)) AS host FROM pages)"
ENDS = f"(SELECT host, i, array_to_string(string_split(host, '.')[i:], '.') AS suffix FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM {HOSTS})))"


@query(
    f"""WITH s AS (SELECT DISTINCT suffix FROM {ENDS} e WHERE len(string_split(suffix, '.')) = 1 OR (len(string_split(suffix, '.')) = 2 AND length(host) % 4 = 0)), f AS (SELECT host, min(i) AS i FROM {ENDS} JOIN s USING (suffix) GROUP BY 1)
    SELECT page_id, host, array_to_string(string_split(host, '.')[coalesce(greatest(i - 1, 1), greatest(len(string_split(host, '.')) - 1, 1)):], '.') AS registered FROM {HOSTS} LEFT JOIN f USING (host)"""
)
def registered_domains(spark, sf_dir):
    """Suffixes: every last label, and the last two of some hosts."""
    pages = table(spark, sf_dir, "pages")
    labels = F.split("host", r"\.")
    ends = T.domain_functions(pages, "url").select("host", F.explode(F.array(F.element_at(labels, -1), F.when((F.size(labels) > 1) & (F.length("host") % 4 == 0), F.array_join(F.slice(labels, -2, 2), ".")))).alias("suffix"))
    return T.domain_functions(pages, "url", suffixes=ends.filter("suffix is not null").select("suffix").distinct()).select("page_id", "host", "registered")


MAILS = "(SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a.example' WHEN 1 THEN 'b.example' ELSE 'x.example' END AS f, 1 + CAST(c_custkey % 11 = 0 AS INT) AS n, CASE c_custkey % 2 WHEN 0 THEN 'mail.a.example' ELSE 'b.example' END AS k, c_custkey % 5 > 0 AS ok, 'a.example' AS e, c_custkey % 4 = 0 AS spf FROM customer)"


@query(f"SELECT c_custkey, n = 1 AND fb IS NOT NULL AND ((coalesce(kb = fb, false) AND ok) OR (coalesce(eb = fb, false) AND spf)) AS aligned FROM (SELECT *, CASE f WHEN 'a.example' THEN 'A' WHEN 'b.example' THEN 'B' END AS fb, CASE k WHEN 'mail.a.example' THEN 'A' ELSE 'B' END AS kb, 'A' AS eb FROM {MAILS})")
def sender_alignment(spark, sf_dir):
    key = F.col("c_custkey")
    mails = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 3 == 0, "a.example").when(key % 3 == 1, "b.example").otherwise("x.example").alias("from_domain"), (1 + (key % 11 == 0).cast("int")).alias("from_count"),
        F.when(key % 2 == 0, "mail.a.example").otherwise("b.example").alias("dkim_domain"), (key % 5 > 0).alias("dkim_ok"), F.lit("a.example").alias("env_domain"), (key % 4 == 0).alias("spf_ok"),
    )
    domains = spark.createDataFrame([("a.example", "A"), ("mail.a.example", "A"), ("b.example", "B")], "domain string, bank string")
    return T.sender_alignment(mails, domains).select("c_custkey", "aligned")


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9._-]', '', 'g') AS local_part FROM customer")
def address_local_part(spark, sf_dir):
    return T.address_local_part(table(spark, sf_dir, "customer"), "c_name", "c_custkey").select("c_custkey", "local_part")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '@' || c_name WHEN 1 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS user_label FROM customer")
def user_label(spark, sf_dir):
    key = F.col("c_custkey")
    return T.user_label(table(spark, sf_dir, "customer").withColumn("h", F.when(key % 3 == 0, F.col("c_name")).otherwise(" ")).withColumn("f", F.when(key % 3 == 1, F.col("c_mktsegment"))), "h", "f", "c_custkey").select("c_custkey", "user_label")


# 16 is 1 short of a divisor of a power that ends in 00, so the last 12 hex digits don't settle the rest; DuckDB takes the number whole
@query("SELECT doc_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(regexp_extract_all(sha256(CAST(doc_id AS VARCHAR)), '.'), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100) AS BIGINT) AS bucket, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(regexp_extract_all(sha256(CAST(doc_id AS VARCHAR)), '.'), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100) < 25 AS chosen FROM documents")
def bucket_percent(spark, sf_dir):
    return T.bucket_percent(docs(spark, sf_dir), "doc_id", 25).select("doc_id", "bucket", "chosen")


@query("SELECT page_id FROM pages WHERE ends_with(lower(url), '.pdf') OR starts_with(html, '<!DOCTYPE')")
def type_gate(spark, sf_dir):
    return T.type_gate(table(spark, sf_dir, "pages"), "url", "html", ext=".pdf", magic="<!DOCTYPE").select("page_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars > 100")
def usable_rows(spark, sf_dir):
    return T.usable_rows(docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left"), [F.col("quality") == 1, F.col("n_chars") > 100]).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events")
def clean_numeric(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 > 0, F.col("value").cast("string")).when(F.col("event_id") % 2 == 0, "NaN").otherwise("Infinity")
    return T.clean_numeric(table(spark, sf_dir, "events").select("event_id", v.alias("value")), ["value"])


STATUS = {"failed": "disgusting|stupid", "pending": "onth", "success": "[Tt]he "}


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in STATUS.items()) + " ELSE 'unknown' END AS status FROM documents")
def status_class(spark, sf_dir):
    return T.status_class(docs(spark, sf_dir), "text", **STATUS).select("doc_id", "status")


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in sorted(STATUS.items())) + ") AS classes, " + " + ".join(f"CAST(regexp_matches(text, '{p}') AS INT)" for p in STATUS.values()) + " > 1 AS conflict FROM documents")
def status_conflict(spark, sf_dir):
    return T.status_conflict(docs(spark, sf_dir), "doc_id", "text", STATUS)


ROUTES = {"notice": ("License", "rights reserved"), "contact": ("@", "+1"), "table": (" | ",)}


@query(
    "SELECT doc_id, CASE WHEN a = m AND a > 0 THEN 'notice' WHEN b = m AND b > 0 THEN 'contact' WHEN c = m AND c > 0 THEN 'table' ELSE 'unknown' END AS route FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in ws) + f") AS {n}" for n, ws in zip("abc", ROUTES.values())) + " FROM documents))"
)
def document_router(spark, sf_dir):
    return T.document_router(docs(spark, sf_dir), "text", ROUTES).select("doc_id", "route")


PROFILES = [("english", 1, ["the ", "and "], ["src1"], ["Released under the MIT"]), ("german", 2, ["der ", "und ", "ung"], ["src2", "src3"], []), ("latin", 3, ["que", "la "], ["src1"], ["CC BY-NC"])]


def _share(markers, producers, exclusive):
    m = " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in markers)
    p = " + ".join(f"CAST(contains(source, '{w}') AS INT)" for w in producers)
    x = " OR ".join([f"contains(text, '{w}')" for w in exclusive] or ["false"])
    return f"CASE WHEN {x} THEN 1.0 WHEN {m} = 0 THEN least(({m} + {p}) / {len(markers) + len(producers)}, 0.55) ELSE ({m} + {p}) / {len(markers) + len(producers)} END"


@query(
    "SELECT doc_id, CASE WHEN s >= 0.5 THEN issuer END AS issuer, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS r FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS issuer, {o} AS ord, CAST({_share(m, p, x)} AS DOUBLE) AS s FROM documents" for i, o, m, p, x in PROFILES) + ")) WHERE r = 1"
)
def issuer_identify(spark, sf_dir):
    profiles = spark.createDataFrame(PROFILES, "issuer string, ord int, markers array<string>, producers array<string>, exclusive array<string>")
    return T.issuer_identify(docs(spark, sf_dir), "doc_id", "text", "source", profiles)


CHANNELS = (("@", "mail", "plain"), (r"\+1 \(", "phone", "us"), (" [|] ", "table", ""))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for p, c, _ in CHANNELS) + " ELSE 'other' END AS channel, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{s}'" for p, _, s in CHANNELS) + " ELSE '' END AS subtype FROM documents")
def channel_subtype(spark, sf_dir):
    return T.channel_subtype(docs(spark, sf_dir), "text", CHANNELS).select("doc_id", "channel", "subtype")


@query("SELECT *, CASE WHEN votes_a > 0 AND votes_b > 0 THEN 'conflict' WHEN votes_a >= 2 THEN 'A' WHEN votes_b >= 2 THEN 'R' ELSE 'unknown' END AS emitter FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS votes_a, count(*) FILTER (WHERE l_returnflag = 'R') AS votes_b FROM lineitem GROUP BY 1)")
def emitter_vote(spark, sf_dir):
    return T.emitter_vote(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "A", "R")


@query("SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'foreign' WHEN contains(source, 'src2') OR contains(source, 'src3') THEN 'own' ELSE 'unknown' END AS producer_class FROM documents")
def producer_lists(spark, sf_dir):
    return T.producer_lists(docs(spark, sf_dir), "source", ["src2", "src3"], ["src1"]).select("doc_id", "producer_class")


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN CASE WHEN mail THEN '' ELSE 'mail' END ELSE CASE WHEN phone THEN '' ELSE 'phone' END END AS missing, CASE lang WHEN 'en' THEN CASE WHEN phone THEN 'phone' ELSE '' END ELSE concat_ws(',', CASE WHEN mail THEN 'mail' END, CASE WHEN notice THEN 'notice' END) END AS unexpected
    FROM (SELECT doc_id, lang, contains(text, '@') AS mail, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS phone, contains(text, 'License') AS notice FROM documents WHERE lang IN ('en', 'de'))"""
)
def field_contract(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", F.regexp_extract("text", "@", 0).alias("mail"), F.regexp_extract("text", "[0-9]{3}-[0-9]{4}", 0).alias("phone"), F.regexp_extract("text", "License", 0).alias("notice"))
    contracts = spark.createDataFrame([("en", ["mail"], ["phone"]), ("de", ["phone"], ["mail", "notice"])], "method string, required array<string>, forbidden array<string>")
    return T.field_contract(rows, "doc_id", "lang", ["mail", "phone", "notice"], contracts)


@query("SELECT doc_id, concat_ws(',', CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, 'License') THEN 'notice' END, CASE WHEN contains(text, '+1 (') THEN 'phone' END) AS methods, CAST(contains(text, '@') AS INT) + CAST(contains(text, 'License') AS INT) + CAST(contains(text, '+1 (') AS INT) > 1 AS mixed FROM documents")
def mixed_methods(spark, sf_dir):
    has = lambda w: F.contains(F.col("text"), F.lit(w))
    return T.mixed_methods(docs(spark, sf_dir), "doc_id", {"mail": has("@"), "phone": has("+1 ("), "notice": has("License")})


@query("SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS BIGINT) + CAST(o_orderkey % 3 = 0 AS BIGINT) AS bad, o_orderkey % 6 = 0 AS decisive FROM orders")
def label_value_binding(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Sum\n\n"), F.when(key % 2 == 0, "Jane").otherwise("120,50"), F.lit("\nName\n"), F.when(key % 3 == 0, "77").otherwise("Jane"), F.lit("\n"))
    return T.label_value_binding(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t", {"Sum": "^[0-9,]+$", "Name": "^[A-Za-z]+$"})


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def active_window(spark, sf_dir):
    return T.active_window(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 5, 9) AND lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey BETWEEN 20 AND 30)")
def blocklist_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    blocked = spark.createDataFrame([(1,), (5,), (9,)], "user long").withColumn("handle", F.lit(None).cast("string")).union(c.filter("c_custkey between 20 and 30").select(F.lit(None).cast("long"), F.upper("c_name")))
    return T.blocklist_filter(c, "c_custkey", "c_name", blocked).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR DATE '1998-01-01' - CAST(o_orderdate AS DATE) <= 400")
def stale_filter(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 10 == 0, "no date").otherwise(F.concat(F.lit("on "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" and 01.01.1990"), F.lit("\n--\nprinted 01.01.1998")))
    return T.stale_filter(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "t", as_of="1998-01-01", days=400, footer="\n--\n").select("o_orderkey")
