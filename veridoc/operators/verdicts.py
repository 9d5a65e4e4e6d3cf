"""Flags and verdicts: a long table (doc, code, tier, grp, ...) of evidence, rule tables as data, and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


#: Columns of a rule table. A null `bank` is every bank; a null `tier` is that of the code's prefix, a null `grp` the code.
CATALOG = "code string, tier string, grp string, bank string, kind string, expr string, enabled boolean"
#: Rules that one table may hold. It is read by the driver, which makes one expression of it.
MAX_RULES = 20_000


def compiled(df: DataFrame, catalog: DataFrame, bank: str | None = None) -> Column:
    """The rules of `catalog` that are enabled as one column over `df`: an array of (code, tier, grp, kind), one for each rule that holds.

    Each rule is held against `df` before: one that names a column `df` lacks, isn't a predicate, or belongs to a
    bank although there is no bank column, is refused by its code. Codes of one bank are told once.
    """
    rules = catalog.filter(F.coalesce("enabled", F.lit(True))).select("code", "tier", "grp", "bank", "kind", "expr").distinct().orderBy("bank", "code", "expr").limit(MAX_RULES + 1).collect()
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule table holds {MAX_RULES} rules at most")
    empty, by_bank = df.limit(0), {}
    for r in rules:
        try:
            kind = empty.select(F.expr(r["expr"])).schema[0].dataType
        except AnalysisException as e:
            raise ValueError(f"rule {r['code']} can't be held against these columns: {r['expr']}") from e
        if not isinstance(kind, BooleanType):
            raise ValueError(f"rule {r['code']} is no predicate: {r['expr']}")
        if r["bank"] is not None and bank is None:
            raise ValueError(f"rule {r['code']} is one of bank {r['bank']}, but there is no bank column")
        tier, grp = r["tier"] or (r["code"][:1] if r["code"][:2] in ("A-", "B-", "C-") else None), r["grp"] or r["code"]
        flag = F.struct(*[F.lit(v).cast("string").alias(c) for c, v in (("code", r["code"]), ("tier", tier), ("grp", grp), ("kind", r["kind"]))])
        by_bank.setdefault(r["bank"], []).append(F.when(F.expr(r["expr"]), flag))
    none = F.array().cast("array<struct<code: string, tier: string, grp: string, kind: string>>")
    fired = {b: F.array_compact(F.array(*tests)) for b, tests in by_bank.items()}
    every = fired.pop(None, none)
    own = none
    for b, flags in fired.items():  # of the banks' rules only those of the row's bank are evaluated
        own = F.when(F.col(bank) == b, flags).otherwise(own)
    return F.array_distinct(F.concat(every, own))


def rule_eval(df: DataFrame, doc: str, catalog: DataFrame, *, bank: str | None = None) -> DataFrame:
    """(doc, code, tier, grp, kind): a row for each rule of the table `catalog` (CATALOG) that holds for a document.

    One pass over the documents. Rules are Spark SQL predicates over their columns, null is no; those that aren't
    enabled are left out, those of another bank than the document's too. A rule without tier or prefix has a null tier.
    """
    return df.select(doc, F.explode(compiled(df, catalog, bank)).alias("_f")).select(doc, "_f.*")


def flag_code(df: DataFrame, flag: str) -> DataFrame:
    """The leading [CODE] of a flag text; "" where there is none."""
    return df.withColumn("code", F.regexp_extract(flag, r"^\s*\[([A-Za-z0-9_-]+)\]", 1))


def classify_flag(flags: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tier and group by the catalog (code, tier, grp); else the tier of the prefix A-, B- or C-, with the code as group; else the flag goes."""
    known = flags.join(catalog, "code", "left")
    prefix = F.regexp_extract("code", "^([ABC])-", 1)
    tier = F.coalesce("tier", F.when(prefix != "", prefix))
    return known.withColumn("tier", tier).withColumn("grp", F.coalesce("grp", "code")).filter(F.col("tier").isNotNull())


def split_forgery_flags(flags: DataFrame, *, deny: Sequence[str], deny_prefix: Sequence[str], allow: Sequence[str], allow_prefix: Sequence[str], phrases: Sequence[str] = (), detail: str | None = None) -> DataFrame:
    """`evidence` is whether a flag counts; of the lists, in the given order, the first that knows the code decides."""
    code = F.col("code")
    starts = lambda xs: _any([code.startswith(x) for x in xs])
    said = _any([F.lower(detail).contains(x) for x in phrases]) if detail else F.lit(False)
    return flags.withColumn("evidence", F.when(code.isin(*deny), False).when(starts(deny_prefix), False).when(code.isin(*allow), True).when(starts(allow_prefix), True).otherwise(said))


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def route_stats_only(flags: DataFrame, stats_codes: Sequence[str]) -> DataFrame:
    """`route`: "stats" for corpus statistics, which are no evidence, else "evidence"."""
    return flags.withColumn("route", F.when(F.col("code").isin(*stats_codes), "stats").otherwise("evidence"))


def verdict_from_replies(df: DataFrame, doc: str, text: str, order: Sequence[str], *, fail: str, passed: str, chunk: int = 1000) -> DataFrame:
    """(doc, verdict): FAIL, PASS or UNKNOWN by the first marker that the replies match, put together in order a line each.

    Replies are put together in rows of `chunk`, and each row begins with the last reply of the one before, so a marker
    may stand across two replies anywhere; one that spans three is met unless it lies where two rows part. A document's
    verdict is the strongest of its rows.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    told = df.select(doc, F.coalesce(text, F.lit("")).alias("_t"), (F.row_number().over(w) - 1).alias("_n"))
    at = F.floor(F.col("_n") / chunk)
    rows = told.withColumn("_c", F.explode(F.when((F.col("_n") % chunk == chunk - 1), F.array(at, at + 1)).otherwise(F.array(at))))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "\n")
    marked = rows.groupBy(doc, "_c").agg(said.alias("_said")).select(doc, F.when(F.col("_said").rlike(fail), 2).when(F.col("_said").rlike(passed), 1).otherwise(0).alias("_v"))
    return marked.groupBy(doc).agg(F.get(F.array(F.lit("UNKNOWN"), F.lit("PASS"), F.lit("FAIL")), F.max("_v")).alias("verdict"))


def normalize_verdict(df: DataFrame, *, verdict: str, score: str, hard: str, threshold: int = 60) -> DataFrame:
    """Unknown stays; decisive evidence gives FAKE with 95 at least; else CLEAN with 0."""
    decisive = (F.col(verdict) == "FAKE") | (F.col(hard) > 0) | (F.col(score) >= threshold)
    final = F.when(F.col(verdict) == "UNKNOWN", "UNKNOWN").when(decisive, "FAKE").otherwise("CLEAN")
    return df.withColumn("final_verdict", final).withColumn("final_score", F.when(final == "FAKE", F.greatest(F.col(score), F.lit(95))).when(final == "CLEAN", F.lit(0)).otherwise(F.col(score)).cast("long"))


def policy_verdict(docs: DataFrame, flags: DataFrame, *, doc: str, groups_needed: int = 2) -> DataFrame:
    """(doc, verdict, n_a, b_groups, codes): FAKE by any flag of tier A, or enough distinct groups of tier B."""
    told = flags.groupBy(doc).agg(
        F.count_if(F.col("tier") == "A").alias("n_a"),
        F.countDistinct(F.when(F.col("tier") == "B", F.col("grp"))).alias("b_groups"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"),
    )
    n_a, b = F.coalesce("n_a", F.lit(0)), F.coalesce("b_groups", F.lit(0))
    return docs.select(doc).join(told, doc, "left").select(doc, F.when((n_a > 0) | (b >= groups_needed), "FAKE").otherwise("CLEAN").alias("verdict"), n_a.alias("n_a"), b.alias("b_groups"), F.coalesce("codes", F.lit("")).alias("codes"))


def pipeline_verdict(docs: DataFrame, flags: DataFrame, policy: DataFrame, *, doc: str, bank: str) -> DataFrame:
    """(doc, verdict, reason): each bank's policy row says what an incomplete or wrong document is and how many groups decide.

    `docs` has complete, right_type and conflict; `flags` has tier and grp, and ignored beats the tier.
    `policy` is (bank, incomplete_verdict, wrong_type_verdict, groups_needed), a row for each bank.
    """
    live = flags.filter(~F.coalesce("ignored", F.lit(False)))
    told = live.groupBy(doc).agg(F.count_if(F.col("tier").isin("A", "KNOWN")).alias("hard"), F.countDistinct(F.when(F.col("tier") == "B", F.col("grp"))).alias("groups"))
    every = docs.join(told, doc, "left").join(policy, bank, "left")
    hard, groups = F.coalesce("hard", F.lit(0)), F.coalesce("groups", F.lit(0))
    cases = [
        (~F.col("complete"), F.coalesce("incomplete_verdict", F.lit("FAKE")), "incomplete"),
        (~F.col("right_type"), F.coalesce("wrong_type_verdict", F.lit("UNKNOWN")), "type"),
        (hard > 0, F.lit("FAKE"), "hard"),
        (groups >= F.coalesce("groups_needed", F.lit(2)), F.lit("FAKE"), "groups"),
        (F.col("conflict"), F.lit("FAKE"), "conflict"),
    ]
    verdict = reason = None
    for test, v, why in reversed(cases):
        verdict = F.when(test, v).otherwise(F.lit("CLEAN") if verdict is None else verdict)
        reason = F.when(test, F.lit(why)).otherwise(F.lit("none") if reason is None else reason)
    return every.select(doc, verdict.alias("verdict"), reason.alias("reason"))


def k_of_n_evidence(flags: DataFrame, doc: str, combos: Mapping[str, Sequence[str]]) -> DataFrame:
    """(doc, combo): the named sets of codes that a document has all of."""
    sets = flags.groupBy(doc).agg(F.collect_set("code").alias("_codes"))
    held = F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, codes)), "_codes")) == 0, F.lit(name)) for name, codes in combos.items()]))
    return sets.select(doc, F.explode(held).alias("combo"))


def category_scores(flags: DataFrame, doc: str, caps: DataFrame) -> DataFrame:
    """(doc, score): weights summed by category, each at most its cap (category, cap)."""
    by = flags.groupBy(doc, "category").agg(F.sum("weight").alias("_w")).join(caps, "category", "left")
    return by.groupBy(doc).agg(F.sum(F.least("_w", F.coalesce("cap", "_w"))).alias("score"))


def flag_score(flags: DataFrame, doc: str, weights: Sequence[tuple[str, int]], *, default: int = 50) -> DataFrame:
    """(doc, score): the sum of each flag's weight, by the first substring of `weights` in its code."""
    w = F.lit(default)
    for part, n in reversed(weights):
        w = F.when(F.col("code").contains(part), n).otherwise(w)
    return flags.groupBy(doc).agg(F.sum(w).cast("long").alias("score"))


def merge_verdicts(results: DataFrame, flags: DataFrame, diagnostic: DataFrame, *, doc: str, exempt: Column | None = None, shown: int = 8) -> DataFrame:
    """(doc, merged, suppressed): a FAKE whose flags are all diagnostic becomes CLEAN and names its first flags; others stay."""
    told = flags.join(diagnostic.select("code", F.lit(True).alias("_d")), "code", "left").groupBy(doc).agg(F.bool_and(F.coalesce("_d", F.lit(False))).alias("_only"), F.array_sort(F.collect_set("code")).alias("_codes"))
    out = results.join(told, doc, "left")
    turned = (F.col("verdict") == "FAKE") & F.coalesce("_only", F.lit(False)) & ~(exempt if exempt is not None else F.lit(False))
    return out.select(doc, F.when(turned, "CLEAN").otherwise(F.col("verdict")).alias("merged"), F.when(turned, F.array_join(F.slice("_codes", 1, shown), ",")).otherwise("").alias("suppressed"))


def profile_gate(flags: DataFrame, docs: DataFrame, enabled: DataFrame, *, doc: str, profile: str) -> DataFrame:
    """The flags whose code is enabled for the document's profile (profile, code)."""
    return flags.join(docs.select(doc, profile), doc).join(enabled, [profile, "code"], "left_semi")


def explain_flags(flags: DataFrame, reasons: DataFrame, *, doc: str, limit: int = 5) -> DataFrame:
    """(doc, reasons): the distinct reasons (code, reason) of a document's flags, in order, the first `limit`."""
    told = flags.join(reasons, "code").groupBy(doc).agg(F.array_sort(F.collect_set("reason")).alias("_r"))
    return told.select(doc, F.array_join(F.slice("_r", 1, limit), "; ").alias("reasons"))


def fp_gate(catalog: DataFrame, flags: DataFrame, genuine: DataFrame, *, doc: str, blocked: Sequence[str] = ()) -> DataFrame:
    """(code, hits, safe): how often each code of the catalog fires on genuine documents; unblocked codes that never do are safe."""
    hits = flags.join(genuine.select(doc), doc, "left_semi").groupBy("code").agg(F.countDistinct(doc).alias("hits"))
    return catalog.select("code").distinct().join(hits, "code", "left").select("code", F.coalesce("hits", F.lit(0)).alias("hits")).withColumn("safe", (F.col("hits") == 0) & ~F.col("code").isin(*blocked))


def shadow_agreement(a: DataFrame, b: DataFrame, *, doc: str, verdict: str = "verdict") -> DataFrame:
    """(legacy, candidate, n): how two engines' verdicts on the same documents agree."""
    return a.select(doc, F.col(verdict).alias("legacy")).join(b.select(doc, F.col(verdict).alias("candidate")), doc).groupBy("legacy", "candidate").agg(F.count("*").alias("n")).withColumn("agree", F.col("legacy") == F.col("candidate"))


def eval_rollup(evals: DataFrame, round_col: str) -> DataFrame:
    """Per round: items, caught, missed, errors, unknown, and a score of 10 for each caught, -10 for each missed, -50 for each error."""
    n = lambda c: F.count_if(c)
    caught, missed, error, unknown = (F.col("outcome") == x for x in ("caught", "missed", "error", "unknown"))
    out = evals.groupBy(round_col).agg(F.count("*").alias("scanned"), n(caught).alias("caught"), n(missed).alias("missed"), n(error).alias("errors"), n(unknown).alias("unknown"))
    return out.withColumn("score", 10 * F.col("caught") - 10 * F.col("missed") - 50 * F.col("errors"))


def expected_subset(df: DataFrame, expected: str, observed: str) -> DataFrame:
    """`all_expected`: whether every expected code was observed."""
    return df.withColumn("all_expected", F.size(F.array_except(expected, observed)) == 0)


def disjoint_names(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("disjoint", ~F.arrays_overlap(a, b))


def deep_scan_report(results: DataFrame, bank: str, *, verdict: str, soft: str) -> DataFrame:
    """(bank, files, fakes, soft_flags) for each bank, and a row "TOTAL"."""
    rolled = results.rollup(bank).agg(F.count("*").alias("files"), F.count_if(F.col(verdict) == "FAKE").alias("fakes"), F.sum(soft).cast("long").alias("soft_flags"), F.grouping(bank).alias("_total"))
    return rolled.select(F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(bank)).alias("bank"), "files", "fakes", "soft_flags")
