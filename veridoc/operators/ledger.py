"""A campaign of checks, credits and payouts. Amounts are whole minor units; every step can be run again without effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.session import by_known, known


def intake_decision(uploads: DataFrame, *, order: Sequence[str], file_hash: str, supported: Column, score: Column, unknown: Column, failed: Column, in_time: Column, pending: Column) -> DataFrame:
    """`decision`: the first gate that holds - duplicate, unsupported, fake (score from 60), unknown, failed, date, pending - else accept.

    Uploads without a file hash duplicate nothing.
    """
    number = F.when(known(file_hash), F.row_number().over(Window.partitionBy(*by_known(file_hash, order)).orderBy(*order))).otherwise(1)
    gates = [(number > 1, "duplicate"), (~supported, "unsupported"), (score >= 60, "fake"), (unknown, "unknown"), (failed, "failed"), (~in_time, "date"), (pending, "pending")]
    out = uploads.withColumn("_n", number)
    decision = F.lit("accept")
    for test, name in reversed(gates[1:]):
        decision = F.when(test, name).otherwise(decision)
    return out.withColumn("decision", F.when(F.col("_n") > 1, "duplicate").otherwise(decision)).drop("_n")


def credit_idempotent(checks: DataFrame, ledger: DataFrame, *, reward: int) -> DataFrame:
    """The ledger rows to add: one credit for each accepted check that has none."""
    done = ledger.filter("type = 'credit'").select("check_id").distinct()
    new = checks.filter("status = 'accepted'").select("check_id", "user_id").dropDuplicates(["check_id"]).join(done, "check_id", "left_anti")
    return new.select("check_id", "user_id", F.lit("credit").alias("type"), F.lit(reward).cast("long").alias("amount"))


def reverse_credit(ledger: DataFrame, rejected: DataFrame) -> DataFrame:
    """The ledger rows to add: the negative of each rejected check's credit, once."""
    credits = ledger.filter("type = 'credit'").groupBy("check_id", "user_id").agg(F.sum("amount").alias("amount"))
    done = ledger.filter("type = 'reversal'").select("check_id").distinct()
    return credits.join(rejected.select("check_id").distinct(), "check_id").join(done, "check_id", "left_anti").select("check_id", "user_id", F.lit("reversal").alias("type"), (-F.abs("amount")).alias("amount"))


def moderate(checks: DataFrame, requests: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks after, audit). A request (check_id, action, at) takes effect if the transition table (from_status, action, to_status) has it
    for the check's status; of several for one check the first counts. Every request is in the audit with its outcome."""
    first = F.row_number().over(Window.partitionBy("check_id").orderBy("at", "action"))
    tried = requests.withColumn("_n", first).join(checks.select("check_id", "status"), "check_id", "left")
    t = transitions.select(F.col("from_status").alias("status"), "action", "to_status")
    told = tried.join(t, ["status", "action"], "left")
    outcome = F.when(F.col("status").isNull(), "missing").when(F.col("_n") > 1, "superseded").when(F.col("to_status").isNull(), "refused").otherwise("done")
    audit = told.select("check_id", "action", "at", outcome.alias("outcome"), F.when(outcome == "done", F.col("to_status")).alias("to_status"))
    done = audit.filter("outcome = 'done'").select("check_id", F.col("to_status").alias("_to"))
    after = checks.join(done, "check_id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")
    return after, audit


def adjust(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """The ledger rows of adjustments (user_id, amount, reason) that are not zero and have a reason."""
    ok = requests.filter((F.col("amount") != 0) & (F.coalesce(F.trim("reason"), F.lit("")) != ""))
    return ok.select(F.lit(None).cast(dict(ledger.dtypes)["check_id"]).alias("check_id"), "user_id", F.lit("adjust").alias("type"), "amount")


def payout(ledger: DataFrame, payouts: DataFrame) -> DataFrame:
    """(user_id, amount): what users with a positive balance get who weren't paid yet."""
    return balance_asof(ledger).filter("balance > 0").join(payouts.select("user_id").distinct(), "user_id", "left_anti").select("user_id", F.col("balance").alias("amount"))


def balance_asof(ledger: DataFrame, ts: str | None = None, until: str | None = None) -> DataFrame:
    rows = ledger if until is None else ledger.filter(F.col(ts) <= F.lit(until).cast(dict(ledger.dtypes)[ts]))
    return rows.groupBy("user_id").agg(F.sum("amount").alias("balance"))


def balances(checks: DataFrame, ledger: DataFrame) -> DataFrame:
    """(user_id, name, accepted, balance) of every user of either table, with the newest name."""
    c = checks.groupBy("user_id").agg(F.max_by("name", "check_id").alias("name"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    return c.join(balance_asof(ledger), "user_id", "full_outer").select("user_id", "name", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("balance", F.lit(0)).alias("balance"))


def campaign_stats(checks: DataFrame, ledger: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """One row: participants, checks by status, ledger sum, sum of positive balances."""
    c = checks.agg(F.countDistinct("user_id").alias("participants"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])
    positive = F.sum(F.when(F.col("balance") > 0, F.col("balance")).otherwise(0))
    b = balance_asof(ledger).agg(F.struct(F.sum("balance").alias("ledger_sum"), positive.alias("owed"))).scalar()
    return c.withColumn("_b", b).select(*c.columns, "_b.ledger_sum", "_b.owed")


def status_pivot(checks: DataFrame, ledger: DataFrame, payouts: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Per user: checks by status, balance, whether paid."""
    p = checks.groupBy("user_id").pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0, list(statuses))
    paid = payouts.select("user_id", F.lit(True).alias("paid")).distinct()
    return p.join(balance_asof(ledger), "user_id", "left").join(paid, "user_id", "left").withColumn("balance", F.coalesce("balance", F.lit(0))).withColumn("paid", F.coalesce("paid", F.lit(False)))


def invariant_check(checks: DataFrame, ledger: DataFrame, payouts: DataFrame) -> DataFrame:
    """(rule, key): what breaks a rule: two credits or reversals of a check, two payouts of a user, one accepted file twice. Empty is well."""
    twice = lambda df, key, rule: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    return (
        twice(ledger.filter("type = 'credit'"), "check_id", "credit twice")
        .union(twice(ledger.filter("type = 'reversal'"), "check_id", "reversed twice"))
        .union(twice(payouts, "user_id", "paid twice"))
        .union(twice(checks.filter("status = 'accepted'"), "file_hash", "file accepted twice"))
    )
