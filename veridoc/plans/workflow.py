"""Graph queries over the region tree and reply chains, ledger queries over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.operators import graph as G
from veridoc.operators import ledger as L
from veridoc.plans.registry import query, table


def tree(spark, sf_dir):
    """region > nation > customer as one graph for each region; every seventh customer declares another parent."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    rn = n.select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("src"), "n_nationkey")
    cn = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "n_nationkey").alias("src"), "c_custkey")
    edges = rn.select("graph", "src", F.col("node").alias("dst")).union(cn.select("graph", "src", F.col("node").alias("dst")))
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("graph"), F.concat(F.lit("r"), "r_regionkey").alias("node"))
    kids = cn.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("leaves"))
    nodes = (
        roots.select("graph", "node", F.lit(None).cast("string").alias("parent"), F.lit(1).cast("long").alias("declared"))
        .union(rn.join(kids, ["graph", "node"], "left").select("graph", "node", F.col("src"), F.coalesce("leaves", F.lit(1)).cast("long")))
        .union(cn.select("graph", "node", F.when(F.col("c_custkey") % 7 == 0, "n0").otherwise(F.col("src")), F.lit(None).cast("long")))
    )
    return nodes, edges, roots


CN = "(SELECT n_regionkey AS graph, c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"
CHAIN = "(SELECT conv_id AS graph, turn AS src, turn + 1 AS dst FROM conversations WHERE (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations) AND turn <> 2)"


def chains(spark, sf_dir):
    """Each conversation's turns as a chain; the third turn's link is missing."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"), F.col("role"))
    edges = c.select("graph", F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).filter("src != 2").join(c.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_semi").select("graph", "src", "dst")
    return c, edges


@query("SELECT conv_id AS graph, turn AS node FROM conversations WHERE turn <= 2")
def reachable(spark, sf_dir):
    nodes, edges = chains(spark, sf_dir)
    return G.reachable(edges, nodes.filter("node = 0"))


@query("SELECT conv_id AS graph, turn AS node FROM conversations WHERE turn > 2")
def orphans(spark, sf_dir):
    nodes, edges = chains(spark, sf_dir)
    return G.orphans(nodes, edges, nodes.filter("node = 0"))


@query(
    f"""SELECT graph, 'c' || c_custkey AS node, 'parent' AS problem FROM {CN} WHERE c_custkey % 7 = 0 AND n_nationkey <> 0
    UNION ALL SELECT n_regionkey, 'r' || n_regionkey, 'count' FROM (SELECT n_regionkey, sum(greatest(coalesce(n, 0), 1)) AS leaves FROM nation LEFT JOIN (SELECT n_nationkey, count(*) AS n FROM {CN} GROUP BY 1) USING (n_nationkey) GROUP BY 1) WHERE leaves <> 1"""
)
def tree_audit(spark, sf_dir):
    nodes, edges, _ = tree(spark, sf_dir)
    return G.tree_audit(nodes, edges)


@query("SELECT o_custkey AS graph, o_orderkey AS src, o_custkey + 30 AS dst, o_orderkey % 2 AS generation FROM orders WHERE (o_custkey + 30, o_orderkey % 2) NOT IN (SELECT (c_custkey, c_custkey % 2) FROM customer)")
def dangling_refs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 30).alias("dst"), (F.col("o_orderkey") % 2).alias("generation"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 30).alias("graph"), F.col("c_custkey").alias("node"), (F.col("c_custkey") % 2).alias("generation"))
    return G.dangling_refs(c, o)


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def key_conflicts(spark, sf_dir):
    return G.key_conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey")


@query(
    f"""SELECT graph, sha256(string_agg(a || '>' || b || 'x' || n, ',' ORDER BY a || '>' || b || 'x' || n)) AS role_hash FROM (SELECT e.graph, s.role AS a, d.role AS b, count(*) AS n FROM {CHAIN} e
    JOIN conversations s ON s.conv_id = e.graph AND s.turn = e.src JOIN conversations d ON d.conv_id = e.graph AND d.turn = e.dst GROUP BY 1, 2, 3) GROUP BY 1"""
)
def graph_role_hash(spark, sf_dir):
    return G.graph_role_hash(*chains(spark, sf_dir))


STATUSES = ("accepted", "pending", "rejected")
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END"
CHECKS = f"(SELECT o_orderkey AS check_id, o_custkey AS user_id, {STATUS} AS status, 'f' || o_orderkey % 9000 AS file_hash, o_orderpriority AS name FROM orders)"
LEDGER = "(SELECT o_orderkey AS check_id, o_custkey AS user_id, 'credit' AS type, 500 AS amount FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'reversal', -500 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 6 = 0 UNION ALL SELECT NULL, o_custkey, 'adjust', -1 FROM orders WHERE o_orderkey % 50 = 0)"


def checks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("check_id"), F.col("o_custkey").alias("user_id"), F.expr(STATUS).alias("status"), F.concat(F.lit("f"), F.col("o_orderkey") % 9000).alias("file_hash"), F.col("o_orderpriority").alias("name"))


def ledger(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = lambda where, check, kind, amount: o.filter(where).select(check, F.col("o_custkey").alias("user_id"), F.lit(kind).alias("type"), F.lit(amount).cast("long").alias("amount"))
    check = F.col("o_orderkey").alias("check_id")
    done = row("o_orderstatus = 'F' and o_orderkey % 3 = 0", check, "credit", 500).union(row("o_orderstatus = 'F' and o_orderkey % 6 = 0", check, "reversal", -500))
    return done.union(row("o_orderkey % 50 = 0", F.lit(None).cast("long").alias("check_id"), "adjust", -1))


def payouts(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("user_id"))


@query(
    f"""SELECT check_id, CASE WHEN row_number() OVER (PARTITION BY file_hash ORDER BY check_id) > 1 THEN 'duplicate' WHEN check_id % 17 = 0 THEN 'unsupported' WHEN check_id % 100 >= 60 THEN 'fake' WHEN check_id % 13 = 0 THEN 'unknown' WHEN status = 'rejected' THEN 'failed'
    WHEN user_id % 10 = 0 THEN 'date' WHEN status = 'pending' THEN 'pending' ELSE 'accept' END AS decision FROM {CHECKS}"""
)
def intake_decision(spark, sf_dir):
    key = F.col("check_id")
    out = L.intake_decision(checks(spark, sf_dir), order=["check_id"], file_hash="file_hash", supported=key % 17 != 0, score=key % 100, unknown=key % 13 == 0, failed=F.col("status") == "rejected", in_time=F.col("user_id") % 10 != 0, pending=F.col("status") == "pending")
    return out.select("check_id", "decision")


@query(f"SELECT check_id, user_id, 'credit' AS type, CAST(500 AS BIGINT) AS amount FROM {CHECKS} WHERE status = 'accepted' AND check_id % 3 <> 0")
def credit_idempotent(spark, sf_dir):
    return L.credit_idempotent(checks(spark, sf_dir), ledger(spark, sf_dir), reward=500)


@query(f"SELECT check_id, user_id, 'reversal' AS type, CAST(-500 AS BIGINT) AS amount FROM {LEDGER} WHERE type = 'credit' AND check_id % 2 = 1 AND check_id % 9 = 0")
def reverse_credit(spark, sf_dir):
    return L.reverse_credit(ledger(spark, sf_dir), checks(spark, sf_dir).filter("check_id % 9 = 0"))


@query(
    f"""SELECT check_id, action, outcome, CASE WHEN outcome = 'done' THEN CASE action WHEN 'accept' THEN 'accepted' ELSE 'rejected' END END AS to_status FROM (SELECT check_id, action, CASE WHEN n > 1 THEN 'superseded' WHEN (action = 'accept' AND status = 'pending') OR (action = 'reject' AND status IN ('pending', 'accepted')) THEN 'done' ELSE 'refused' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY step) AS n FROM (SELECT check_id, status, CASE WHEN check_id % 2 = 0 THEN 'accept' ELSE 'reject' END AS action, 1 AS step FROM {CHECKS} WHERE check_id % 3 = 0 UNION ALL SELECT check_id, status, 'reject', 2 FROM {CHECKS} WHERE check_id % 15 = 0)))"""
)
def moderate(spark, sf_dir):
    c = checks(spark, sf_dir)
    first = c.filter("check_id % 3 = 0").select("check_id", F.when(F.col("check_id") % 2 == 0, "accept").otherwise("reject").alias("action"), F.lit(1).alias("at"))
    requests = first.union(c.filter("check_id % 15 = 0").select("check_id", F.lit("reject"), F.lit(2)))
    transitions = spark.createDataFrame([("pending", "accept", "accepted"), ("pending", "reject", "rejected"), ("accepted", "reject", "rejected")], "from_status string, action string, to_status string")
    return L.moderate(c, requests, transitions)[1].drop("at")


@query("SELECT CAST(NULL AS BIGINT) AS check_id, c_custkey AS user_id, 'adjust' AS type, c_custkey % 4 - 1 AS amount FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 3 > 0")
def adjust(spark, sf_dir):
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(key.alias("user_id"), (key % 4 - 1).alias("amount"), F.when(key % 3 == 1, "goodwill").when(key % 3 == 2, "error").otherwise(" ").alias("reason"))
    return L.adjust(ledger(spark, sf_dir), requests)


@query(f"SELECT user_id, CAST(sum(amount) AS BIGINT) AS amount FROM {LEDGER} WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) GROUP BY 1 HAVING sum(amount) > 0")
def payout(spark, sf_dir):
    return L.payout(ledger(spark, sf_dir), payouts(spark, sf_dir))


@query("SELECT user_id, CAST(sum(amount) AS BIGINT) AS balance FROM (SELECT o_custkey AS user_id, 1 AS amount FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-01-01') GROUP BY 1")
def balance_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.lit(1).cast("long").alias("amount"), F.to_date("o_orderdate").alias("d"))
    return L.balance_asof(rows, "d", "1996-01-01")


@query(f"SELECT user_id, name, coalesce(accepted, 0) AS accepted, CAST(coalesce(balance, 0) AS BIGINT) AS balance FROM (SELECT user_id, max_by(name, check_id) AS name, count(*) FILTER (WHERE status = 'accepted') AS accepted FROM {CHECKS} GROUP BY 1) FULL JOIN (SELECT user_id, sum(amount) AS balance FROM {LEDGER} GROUP BY 1) USING (user_id)")
def balances(spark, sf_dir):
    return L.balances(checks(spark, sf_dir), ledger(spark, sf_dir))


@query(
    f"SELECT *, (SELECT CAST(sum(amount) AS BIGINT) FROM {LEDGER}) AS ledger_sum, (SELECT CAST(sum(greatest(b, 0)) AS BIGINT) FROM (SELECT sum(amount) AS b FROM {LEDGER} GROUP BY user_id)) AS owed FROM (SELECT count(DISTINCT user_id) AS participants, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in STATUSES) + f" FROM {CHECKS})"
)
def campaign_stats(spark, sf_dir):
    return L.campaign_stats(checks(spark, sf_dir), ledger(spark, sf_dir), STATUSES)


@query(
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + f", CAST(coalesce(any_value(balance), 0) AS BIGINT) AS balance, user_id % 5 = 0 AS paid FROM {CHECKS} LEFT JOIN (SELECT user_id, sum(amount) AS balance FROM {LEDGER} GROUP BY 1) USING (user_id) GROUP BY user_id"
)
def status_pivot(spark, sf_dir):
    return L.status_pivot(checks(spark, sf_dir), ledger(spark, sf_dir), payouts(spark, sf_dir), STATUSES)


@query(f"SELECT 'file accepted twice' AS rule, file_hash AS key FROM {CHECKS} WHERE status = 'accepted' GROUP BY file_hash HAVING count(*) > 1")
def invariant_check(spark, sf_dir):
    return L.invariant_check(checks(spark, sf_dir), ledger(spark, sf_dir), payouts(spark, sf_dir))
