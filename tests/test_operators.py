"""Ties, nulls, empty values and repeated runs, on rows made for them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veridoc.operators import corpus, graph, history, learning, ledger, links, text, verdicts

T0 = datetime(2024, 1, 1)


@pytest.fixture
def log(spark):
    rows = [(1, 0, "P"), (2, 60, "P"), (3, 60, "F"), (4, 120, "P"), (5, 121, "P"), (6, None, "P"), (7, 360, "P")]
    return spark.createDataFrame([(i, "u", None if s is None else T0 + timedelta(seconds=s), v) for i, s, v in rows], "id long, u string, ts timestamp, v string")


def by_id(df, col, key="id"):
    return {r[key]: r[col] for r in df.collect()}


def test_prior_windows_count_ties_by_order_and_both_ends(log):
    out = history.prior_window_counts(log, "ts", F.col("v") == "P", ["ts", "id"], partition=["u"])
    # row 3 has the time of row 2 and comes later; 60 seconds back is still inside, 61 is not
    assert by_id(out, "prior_60s") == {1: 0, 2: 1, 3: 2, 4: 2, 5: 1, 6: 0, 7: 0}
    assert by_id(out, "prior_pass_60s") == {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 0, 7: 0}
    assert by_id(out, "prior_300s")[7] == 4


def test_gap_skips_rows_without_a_time(log):
    gaps = by_id(history.gap_seconds(log, "ts", ["id"], partition=["u"]), "gap_seconds")
    assert gaps == {1: None, 2: 60, 3: 0, 4: 60, 5: 1, 6: None, 7: 239}


def test_running_number_in_two_levels_equals_one_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).alias("k"))
    assert by_id(history.send_index(df, ["k", "id"]), "send_index") == {r["id"]: n + 1 for n, r in enumerate(sorted(df.collect(), key=lambda r: (r["k"], r["id"])))}


def test_empty_key_counts_nothing(spark):
    df = spark.createDataFrame([(1, "", "P"), (2, "", "F"), (3, None, "P"), (4, "a", "P"), (5, "a", "F")], "id long, k string, v string")
    assert by_id(history.prior_same_key(df, ["k"], F.col("v") == "P", ["id"]), "prior_k_rows") == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_streak_is_reset(log):
    assert by_id(history.clean_streak(log, F.col("v") == "P", ["id"], partition=["u"]), "streak") == {1: 1, 2: 2, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4}


def flags_of(spark, rows):
    return spark.createDataFrame(rows, "doc string, code string, tier string, grp string")


def test_policy_needs_two_groups_of_tier_b(spark):
    docs = spark.createDataFrame([(d,) for d in "abcd"], "doc string")
    flags = flags_of(spark, [("a", "B1", "B", "x"), ("a", "B2", "B", "x"), ("b", "B1", "B", "x"), ("b", "B3", "B", "y"), ("c", "A1", "A", "A1")])
    assert by_id(verdicts.policy_verdict(docs, flags, doc="doc"), "verdict", "doc") == {"a": "CLEAN", "b": "FAKE", "c": "FAKE", "d": "CLEAN"}


def test_a_flag_that_is_no_evidence_changes_no_verdict(spark):
    docs = spark.createDataFrame([(d,) for d in "ab"], "doc string")
    flags = flags_of(spark, [("a", "B1", "B", "x"), ("b", "A1", "A", "A1")])
    more = flags.union(flags_of(spark, [("a", "S1", "STATS", "s"), ("b", "S1", "STATS", "s")]))
    verdict = lambda f: by_id(verdicts.policy_verdict(docs, f, doc="doc"), "verdict", "doc")
    assert verdict(flags) == verdict(more)


def test_prefix_gives_the_tier_only_where_the_catalog_is_silent(spark):
    flags = spark.createDataFrame([("d", c) for c in ("A-X", "A-Y", "Z")], "doc string, code string")
    catalog = spark.createDataFrame([("A-Y", "IGNORED", "g")], "code string, tier string, grp string")
    assert {(r["code"], r["tier"], r["grp"]) for r in verdicts.classify_flag(flags, catalog).collect()} == {("A-X", "A", "A-X"), ("A-Y", "IGNORED", "g")}


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.1,), (None,)], "x double")
    assert {(r["lo"], r["hi"], r["n"]) for r in corpus.numeric_bins(df, "x", [0, 1, 2], F.lit(True)).collect()} == {(0.0, 1.0, 1), (1.0, 2.0, 2)}


def test_envelope_falls_back_and_missing_bounds_pass(spark):
    df = spark.createDataFrame([("in", "b", "c", 5.0), ("edge", "b", "c", 10.0), ("out", "b", "c", 11.0), ("far", "b", "new", 31.0), ("free", "z", "c", 99.0)], "doc string, bank string, channel string, m double")
    bounds = spark.createDataFrame([("b", "c", "m", 0.0, 10.0), ("b", None, "m", 0.0, 30.0)], "bank string, channel string, metric string, lo double, hi double")
    assert {r["doc"] for r in corpus.envelope_check(df, "doc", "bank", "channel", ["m"], bounds).collect()} == {"out", "far"}


def test_upper_median(spark):
    df = spark.createDataFrame([("d", x) for x in (1, 2, 8, 9)], "doc string, x long")
    assert corpus.cluster_spread(df, "doc", "x", band=1, min_n=2).collect()[0].asDict() == {"doc": "d", "pin": 8, "members": 2, "span": 1}


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    m = corpus.binary_metrics(df, "y", "s").head()
    assert m["auc"] == 0.875 and m["tp"] == 2 and m["fp"] == 1


def test_conflict_needs_another_file_and_another_signature(spark):
    rows = [(1, "id", "f1", "s1"), (2, "id", "f1", "s1"), (3, "id", "f2", "s1"), (4, "id", "f3", "s2"), (5, "", "f4", "s1"), (6, "", "f5", "s2"), (7, None, "f6", "s1")]
    df = spark.createDataFrame(rows, "n long, id string, f string, s string")
    assert by_id(links.identity_conflict(df, "id", "f", "s", ["n"]), "conflict", "n") == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_conflict_equals_all_pairs(spark):
    r = random.Random(1)
    rows = [(n, r.choice(["a", "b", "", None]), r.choice(["f0", "f1", "f2", "", None]), r.choice(["A", "B", "C", "", None])) for n in range(400)]
    want = {n: bool(i and f and s) and any(j == i and g and t and g != f and t != s for m, j, g, t in rows[:n]) for n, i, f, s in rows}
    assert by_id(links.identity_conflict(spark.createDataFrame(rows, "n long, id string, f string, s string"), "id", "f", "s", ["n"]), "conflict", "n") == want


def test_rows_without_a_hash_duplicate_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "x"), (5, "x")], "n long, h string")
    assert by_id(history.unique_in_batch(df, "h", ["n"]), "is_unique", "n") == {1: True, 2: True, 3: True, 4: True, 5: False}
    yes, no = F.lit(True), F.lit(False)
    got = ledger.intake_decision(df, order=["n"], file_hash="h", supported=yes, score=F.lit(0), unknown=no, failed=no, in_time=yes, pending=no)
    assert by_id(got, "decision", "n") == {1: "accept", 2: "accept", 3: "accept", 4: "accept", 5: "duplicate"}
    assert by_id(links.dedup_two_keys(df.withColumn("i", F.lit(None).cast("string")), "h", "i", ["n"], "n"), "duplicate_of", "n") == {1: None, 2: None, 3: None, 4: None, 5: 4}


def test_dependency_check_tells_repeated_rows_again(spark):
    known = spark.createDataFrame([("k", "a"), ("k", "b")], "k string, v string")
    df = spark.createDataFrame([("k", "c", {"m": 1}), ("k", "c", {"m": 1}), ("k", "a", None), ("x", "c", None), ("k", None, None)], "k string, v string, extra map<string, int>")
    assert [(r["k"], r["v"]) for r in corpus.dependency_check(df, "k", "v", known).collect()] == [("k", "c")] * 2


def test_artifact_hash_tells_repeats(spark, tmp_path):
    from veridoc.sources.io import sink_versioned_artifacts

    twice = {n: spark.createDataFrame([(v,), (v,)], "v string") for n, v in (("a", "a"), ("b", "b"))}
    hashes = [r["content_hash"] for r in sink_versioned_artifacts(twice, str(tmp_path), "v1").collect()]
    assert len(set(hashes)) == 2


def test_running_sums_equal_one_window(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500 / 7).alias("s"), (F.col("id") % 5).alias("p"))
    rows, total, want = sorted(map(tuple, df.collect()), reverse=True), 0, []
    for s, p in rows:
        total += p
        want.append((s, p, total))
    assert sorted((r["s"], r["p"], r["up"]) for r in corpus.running_sums(df, F.desc("s"), {"p": "up"}).collect()) == sorted(want)


def test_shell_overlap_equals_all_pairs(spark):
    r = random.Random(3)
    parts = [(d, p, r.randrange(2), d % 3) for d in range(60) for p in range(r.randint(1, 6))]
    refs = [(100 + d, p, r.randrange(2), d % 3) for d in range(12) for p in range(r.randint(1, 6))]
    a, b = spark.createDataFrame(parts, "doc long, part long, h long, who long"), spark.createDataFrame(refs, "ref long, part long, h long, who long")
    for static, identity in ((None, None), (F.col("part") == 0, "who")):
        want = set()
        for ref in {x[0] for x in refs}:
            mine = {(p, h): w for x, p, h, w in refs if x == ref}
            for d in range(60):
                own = {(p, h): w for x, p, h, w in parts if x == d}
                n = len(mine.keys() & own.keys())
                ok = len(mine) >= 2 and n >= len(mine) - 1 and (n < len(mine) or n < len(own))
                if static is not None:
                    ok = ok and all(k in own for k in mine if k[0] == 0) and d % 3 != (ref - 100) % 3
                if ok:
                    want.add((d, ref, n, len(mine)))
        assert {tuple(x) for x in links.shell_overlap(a, b, "doc", "ref", "part", "h", static=static, identity=identity).collect()} == want and want


@pytest.mark.parametrize("missing", [0, 1, 2, 3])
def test_shell_overlap_by_several_parts_equals_all_pairs(spark, monkeypatch, missing):
    """Common parts alone, so all is looked up by several at once; documents with many parts, parts given twice, parts without a hash."""
    monkeypatch.setattr(links, "COMBINED", 40)
    r = random.Random(missing)
    draw = lambda ids, most: [(d, p, None if r.random() < 0.05 else r.randrange(2)) for d in ids for _ in range(r.choice([5, 9, most])) for p in [r.randrange(8)]]
    parts, refs = draw(range(80), 30), draw(range(100, 140), 12)
    a, b = spark.createDataFrame(parts, "doc long, part long, h long"), spark.createDataFrame(refs, "ref long, part int, h int")
    want = set()
    for ref in {x[0] for x in refs}:
        mine = {x[1:] for x in refs if x[0] == ref}
        for d in range(80):
            own = {x[1:] for x in parts if x[0] == d}
            n = len({x for x in mine & own if x[1] is not None})
            if len(mine) > missing and len(mine) >= 4 and n >= len(mine) - missing and (n < len(mine) or n < len(own)):
                want.add((d, ref, n, len(mine)))
    for crowd in (0, 100, 10**6):
        assert {tuple(x) for x in links.shell_overlap(a, b, "doc", "ref", "part", "h", missing=missing, least=4, crowd=crowd).collect()} == want and want


@pytest.fixture
def moved(spark):
    """What a call shuffles, in bytes, where no table is small enough to be sent whole; and what it returns."""
    sc, size = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    def call(f):
        small, before = spark.conf.get(size), written()
        spark.conf.set(size, -1)
        try:
            out = f()
        finally:
            spark.conf.set(size, small)
        return written() - before, out

    return call


def test_shell_overlap_makes_no_pair_for_each_common_part(spark, tmp_path, moved):
    """20,000 documents and 2,000 registered ones of seven common parts: by the two rarest alone eight million pairs were dealt out."""
    made = lambda n, name: spark.range(n).withColumnRenamed("id", name).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("h", F.pmod(F.xxhash64(name, "part", F.lit(name)), F.lit(10)))
    for n, name in ((20_000, "doc"), (2_000, "ref")):
        made(n, name).write.parquet(f"{tmp_path}/{name}")
    docs, refs = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("doc", "ref"))
    size, got = moved(lambda: links.shell_overlap(docs, refs, "doc", "ref", "part", "h", least=6).collect())
    a, b = ({n: set() for n in range(k)} for k in (20_000, 2_000))
    for rows, out in ((docs, a), (refs, b)):
        for x in rows.collect():
            out[x[0]].add((x["part"], x["h"]))
    by = {}
    for d, own in a.items():
        for x in own:
            by.setdefault(frozenset(own - {x}), []).append(d)
    want = {(d, ref) for ref, mine in b.items() for x in mine for d in by.get(frozenset(mine - {x}), ()) if a[d] != mine}
    assert {(x["doc"], x["ref"]) for x in got} == want
    assert size < 20e6


def test_shell_overlap_makes_no_pair_for_each_copy(spark, tmp_path, moved):
    """20,000 copies of a document that is registered 2,000 times, and one of them without a part."""
    made = lambda n, name: spark.range(n).withColumnRenamed("id", name).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("h", F.lit(1))
    made(20_001, "doc").filter("doc < 20000 or part < 7").write.parquet(f"{tmp_path}/doc")
    made(2_000, "ref").write.parquet(f"{tmp_path}/ref")
    docs, refs = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("doc", "ref"))
    size, got = moved(lambda: links.shell_overlap(docs, refs, "doc", "ref", "part", "h", least=6).collect())
    assert sorted(map(tuple, got)) == [(20_000, n, 6, 7) for n in range(2_000)]
    assert size < 20e6


def test_nearest_template_without_a_tolerance(spark):
    df, t = spark.createDataFrame([(1, 5.0), (2, 5.5)], "doc long, x double"), spark.createDataFrame([("a", 5.0), ("b", 9.0)], "template string, at double")
    assert [tuple(r) for r in links.nearest_template(df, "doc", "x", t, tol=0).collect()] == [(1, "a", 0.0)]


def test_upsert_run_again_changes_nothing(spark):
    from veridoc.sources.io import sink_upsert

    current = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "late"), (3, 1, "d")], "k long, at long, v string")
    once = sink_upsert(new, current, ["k"], "at")
    assert sorted(map(tuple, once.collect())) == [(1, 2, "c"), (2, 5, "b"), (3, 1, "d")] == sorted(map(tuple, sink_upsert(new, once, ["k"], "at").collect()))


def test_credit_and_reversal_happen_once(spark):
    checks = spark.createDataFrame([(1, 7, "accepted"), (1, 7, "accepted"), (2, 7, "pending")], "check_id long, user_id long, status string")
    empty = spark.createDataFrame([], "check_id long, user_id long, type string, amount long")
    first = empty.union(ledger.credit_idempotent(checks, empty, reward=5))
    assert [r["amount"] for r in first.collect()] == [5] and ledger.credit_idempotent(checks, first, reward=5).isEmpty()
    second = first.union(ledger.reverse_credit(first, checks.filter("check_id = 1")))
    assert by_id(ledger.balance_asof(second), "balance", "user_id") == {7: 0} and ledger.reverse_credit(second, checks).isEmpty()


def test_tree_with_a_cycle_and_a_shared_node(spark):
    nodes = spark.createDataFrame([("g", n, p, d) for n, p, d in (("r", None, 2), ("a", "r", None), ("b", "r", None), ("x", "y", None), ("y", "x", None))], "graph string, node string, parent string, declared long")
    edges = spark.createDataFrame([("g", *e) for e in (("r", "a"), ("r", "b"), ("a", "b"), ("x", "y"), ("y", "x"))], "graph string, src string, dst string")
    got = {(r["node"], r["problem"]) for r in graph.tree_audit(nodes, edges).collect()}
    assert {("b", "shared"), ("b", "parent"), ("x", "cycle"), ("y", "cycle")} <= got and ("a", "cycle") not in got


def test_dates_amounts_and_ids(spark):
    df = spark.createDataFrame([("1 234,50 at 01.02.2024 10:20",), ("31.02.2024",), (None,)], "t string")
    money = {"1,234.50": 1234.5, "1.234,50": 1234.5, "1 234,5 ₽": 1234.5, "sum 12\u00a0345 RUB": 12345.0, "-7.05": -7.05, "1,234,567": 1234567.0, "0.5": 0.5, "12": 12.0, "+7 123": None, "**12": None, "01.02.2024 5": None, "none": None, "": None}
    got = text.parse_amount(spark.createDataFrame([(t,) for t in [*money, None]], "t string"), "t").collect()
    assert {r["t"]: None if r["amount"] is None else float(r["amount"]) for r in got} == money | {None: None}
    assert [r["printed_at"] for r in text.parse_datetimes(df, "t").collect()] == [datetime(2024, 2, 1, 10, 20), None, None]
    clock = spark.createDataFrame([(366, 23, 59, datetime(2025, 1, 1, 2, 58))], "d int, h int, m int, ts timestamp")
    got = text.id_time_check(clock, "d", "h", "m", "ts").head()
    assert got["hour_ok"] and got["minute_ok"]


def test_bucket_equals_the_whole_number(spark):
    import hashlib

    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    assert by_id(text.bucket_percent(df, "k", 30), "bucket", "k") == {str(i): int(hashlib.sha256(str(i).encode()).hexdigest(), 16) % 100 for i in range(200)}


def catalog(spark, rows):
    return spark.createDataFrame(rows, verdicts.CATALOG)


def test_rule_eval_takes_null_as_no(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    rules = catalog(spark, [("HAS-A", "A", "g", None, "k", "t = 'a'", True), ("NOT-A", None, None, None, None, "t != 'a'", True)])
    assert [tuple(r) for r in verdicts.rule_eval(df, "id", rules).collect()] == [(1, "HAS-A", "A", "g", "k")]


def test_rules_of_a_table(spark):
    """Rules of all banks and of one, disabled ones, tiers by prefix, codes told once; rules that can't be evaluated are refused by name."""
    df = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, None, 5), (4, "x", None)], "id long, bank string, n int")
    rules = [("B-ALL", None, None, None, "k", "n = 5", True), ("A-X", None, "gx", "x", "k", "n > 1", True), ("A-X", None, "gx", "x", "k", "n > 2", True), ("Y", "B", None, "y", "k", "n > 1", True), ("A-DELETED", "A", None, None, "k", "true", False), ("A-GONE", "A", None, "x", "k", "no_such = 1", False), ("C-NULL", None, None, None, None, "id = 4", None)]
    got = sorted(tuple(r) for r in verdicts.rule_eval(df, "id", catalog(spark, rules), bank="bank").collect())
    assert got == [(1, "A-X", "A", "gx", "k"), (1, "B-ALL", "B", "B-ALL", "k"), (2, "B-ALL", "B", "B-ALL", "k"), (2, "Y", "B", "Y", "k"), (3, "B-ALL", "B", "B-ALL", "k"), (4, "C-NULL", "C", "C-NULL", None)]
    for bad, said in (("no_such = 1", "can't be held"), ("n + 1", "no predicate")):
        with pytest.raises(ValueError, match=f"B-BAD.*{said}|B-BAD is {said}"):
            verdicts.rule_eval(df, "id", catalog(spark, [("B-BAD", None, None, None, None, bad, True)]), bank="bank")
    with pytest.raises(ValueError, match="no bank column"):
        verdicts.rule_eval(df, "id", catalog(spark, rules))
    assert verdicts.rule_eval(df, "id", catalog(spark, rules).limit(0)).count() == 0


def history_rows(n, seed):
    """Times that are null, equal, in bursts, and 60 and 300 seconds apart; verdicts that are null."""
    r, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 0, 0, 1, 59, 60, 61, 299, 300, 301, 5000])
        rows.append((i, None if r.random() < 0.1 else T0 + timedelta(seconds=t), r.choice(["PASS", "FAIL", "FAIL", None]), r.choice([None, "", *"abcdefgh"])))
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_global_history_equals_the_loop(spark, parts):
    """Without a partition the features are those of a loop over the whole history, however the ranges fall."""
    rows = history_rows(300, parts)
    in_order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or T0, x[0]))
    want, times, streak, seen, uploads, previous, last = {}, [], 0, set(), 0, "", None
    for i, ts, v, mid in in_order:
        counts = [0] * 4
        if ts is not None:
            for k, s in enumerate((60, 300)):
                near = [x for x in times if (ts - x[0]).total_seconds() <= s]
                counts[2 * k : 2 * k + 2] = len(near), sum(x[1] == "PASS" for x in near)
        if not (mid and mid in seen):
            streak = streak + 1 if v == "PASS" else 0
            if v == "PASS" and mid:
                seen.add(mid)
        uploads += v == "FAIL"
        want[i] = (previous, None if ts is None or last is None else (ts - last).total_seconds(), *counts, streak, uploads)
        previous = v or ""
        if ts is not None:
            times.append((ts, v))
            last = ts
    df = spark.createDataFrame(rows, "id long, ts timestamp, v string, mid string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        order = ["ts", "id"]
        out = history.previous_verdict(df, "v", order)
        out = history.gap_seconds(out, "ts", order)
        out = history.prior_window_counts(out, "ts", F.col("v") == "PASS", order)
        out = history.clean_streak(out, F.col("v") == "PASS", order, ids="mid")
        out = history.reply_attribution(out, F.col("v") == "FAIL", order)
        assert out.columns == [*df.columns, "previous_verdict", "gap_seconds", "prior_60s", "prior_pass_60s", "prior_300s", "prior_pass_300s", "streak", "upload_no"]
        got = {r[0]: tuple(r)[4:] for r in out.collect()}
        assert got == want
        assert history.clean_streak(df.limit(0), F.col("v") == "PASS", order).count() == history.prior_window_counts(df.limit(0), "ts", F.col("v") == "PASS", order).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("parts, n, values", [(1, 3, 8), (9, 3, 8), (9, 10, 8)])
def test_newest_lists_in_ranges(spark, parts, n, values):
    """Lists of the whole table and of a key that most rows have, against the lists themselves, however the ranges fall."""
    r = random.Random(parts + n)
    rows = [(i, "hot" if r.random() < 0.8 else r.choice(["u", "v", None]), r.choice([None, "", *map(str, range(values))]), r.choice(["PASS", "PASS", "PASS", "FAIL", None])) for i in range(500)]
    lists, want, streak, counted = {}, {}, 0, []
    for i, user, h, v in rows:
        met = []
        for key in ("table", ("key", user)):
            recent = lists.setdefault(key, [])
            met.append((h or "") in recent)
            if not met[-1]:
                recent.append(h or "")
                del recent[:-n]
        if not (h and h in counted[-n:]):
            streak = streak + 1 if v == "PASS" else 0
            if v == "PASS" and h:
                counted.append(h)
        want[i] = (*met, streak)
    df = spark.createDataFrame(rows, "i long, u string, h string, v string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = history.seen_recently(df, "h", ["i"], n=n).withColumnRenamed("seen_recently", "a")
        out = history.seen_recently(out, "h", ["i"], partition=["u"], n=n)
        out = history.clean_streak(out, F.col("v") == "PASS", ["i"], ids="h", last=n)
        assert {x["i"]: (x["a"], x["seen_recently"], x["streak"]) for x in out.collect()} == want
        assert history.clean_streak(df.limit(0), F.col("v") == "PASS", ["i"], ids="h", last=n).count() == 0
        quota = history.daily_quota(df.withColumn("t", F.timestamp_seconds(F.col("i") * 700)), "u", "t", ["i"], limit=9)
        used, told = {}, {}
        for i, user, _, _ in rows:
            used[user, i * 700 // 86400] = told[i] = used.get((user, i * 700 // 86400), 0) + 1
        assert {x["i"]: (x["used"], x["allowed"]) for x in quota.collect()} == {i: (k, k <= 9) for i, k in told.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keys_that_most_rows_have(spark):
    """Against plain loops: one key of most rows, others, unknown ones; values that are null."""
    r = random.Random(12)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", "", None]), r.choice(["u", "v", None]), r.choice(["P", "F", None]), r.choice(["hot"] * 3 + ["x", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, user string, v string, k2 string").repartition(9)
    order = ["id"]
    uses, prior, first, dup = {}, {}, {}, {}
    for n, (i, k, user, _, k2) in enumerate(rows):
        before = [x for x in rows[:n] if k and x[1] == k]
        if k:
            users = [x[2] for x in before if x[2] is not None]
            uses[i] = (len(before) + 1, (before or [rows[n]])[0][0], user is not None and any(u != user for u in users))
        prior[i] = (len(before), sum(x[3] == "P" for x in before), sum(x[3] == "F" for x in before))
        first[i] = not before
        by = [next((x[0] for x in rows if key and x[c] == key), i) for c, key in ((1, k), (4, k2))]
        dup[i] = next((x for x in by if x != i), None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = links.email_reuse(df, "k", "user", order, "id")
        assert got.columns == [*df.columns, "use_no", "first_time", "by_other"] and {x["id"]: (x["use_no"], x["first_time"], x["by_other"]) for x in got.collect()} == uses
        got = history.prior_same_key(df, ["k", "k2"], F.col("v") == "P", order)
        assert got.count() == 400 and {x["id"]: (x["prior_k_rows"], x["prior_k_passes"], x["prior_k_fails"]) for x in got.collect()} == prior
        assert by_id(history.unique_in_batch(df, "k", order), "is_unique") == first
        assert by_id(links.dedup_two_keys(df, "k", "k2", order, "id"), "duplicate_of") == dup
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_resolve_copy_keeps_every_row(spark):
    """Rows that share a key or have none, sizes that are null, candidates by the dozen: each row its own best one."""
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "a", "b", "c", "zz"]), r.choice([None, 1, 2, 3])) for i in range(80)]
    found = [(r.choice([None, "", "a", "b", "c"]), r.choice(["chat", "disk"]), r.choice([None, *"pqrstu"]), r.choice([None, 1, 2])) for _ in range(60)]
    want = {}
    for i, key, size in rows:
        best = min(((0 if k == "chat" and s == size and size else 1 if s == size and size else 2 if k == "chat" else 3, p is None, p or "", k, p) for x, k, p, s in found if key and x == key), default=None)
        want[i] = (key, size, best and best[3], best and best[4])
    got = links.resolve_copy(spark.createDataFrame(rows, "id long, key string, size long"), spark.createDataFrame(found, "key string, kind string, path string, size long"), "key", "size")
    assert got.columns == ["id", "key", "size", "kind", "path"] and got.count() == 80 and {x["id"]: tuple(x)[1:] for x in got.collect()} == want


def test_weak_matches_once_a_file(spark):
    """Against all pairs: nulls and empty texts in every column, files and ids that repeat; the fields that differ are named."""
    r = random.Random(9)
    rows = [(i, r.choice([None, "", *"xyz"]), r.choice([None, "", *"fghijk"]), r.choice([None, "", "1", "2"]), r.choice([None, 1.0, 2.0])) for i in range(120)]
    there = lambda v: v is not None and v != ""
    want = {}
    for n, (_, key, file, a, b) in enumerate(rows):
        if not (there(key) and there(file) and (there(a) or there(b))) or file in want:
            continue
        earlier = [x for x in rows[:n] if x[1] == key and there(x[2]) and x[2] != file and (there(x[3]) or there(x[4]))]
        if earlier:
            names = [c for c, k in (("a", 3), ("b", 4)) if there(rows[n][k]) and any(there(x[k]) and x[k] != rows[n][k] for x in earlier)]
            want[file] = (key, ",".join(names))
    got = links.weak_match_once(spark.createDataFrame(rows, "n long, id string, file string, a string, b double"), "id", "file", ["a", "b"], ["n"])
    assert {x["file"]: (x["id"], x["differing"]) for x in got.collect()} == want and len(want) > 3 and got.count() == len(want)


def test_lookups_without_a_key(spark):
    rows = spark.createDataFrame([(1, "h", "x"), (2, None, "x"), (3, "", "y"), (4, None, None)], "id long, h string, s string")
    known = [("h", spark.createDataFrame([("h", "H"), (None, "none"), ("", "empty")], "h string, label string")), ("s", spark.createDataFrame([("x", "X"), (None, "none")], "s string, label string"))]
    assert {r["id"]: (r["known_by"], r["known_label"]) for r in links.known_lookup(rows, known).collect()} == {1: ("h", "H"), 2: ("s", "X"), 3: (None, None), 4: (None, None)}
    chat = spark.createDataFrame([("h", 7), (None, 8), (None, 9), ("q", 10)], "h string, size long")
    got = sorted((str(r["id"]), str(r["size"]), r["origin"]) for r in links.log_chat_merge(rows, chat, "h").collect())
    assert got == [("1", "7", "log"), ("2", "None", "log"), ("3", "None", "log"), ("4", "None", "log"), ("None", "10", "chat"), ("None", "8", "chat"), ("None", "9", "chat")]


@pytest.mark.parametrize("crowd", [0, 64])
def test_overlaps_equal_all_pairs(spark, crowd):
    """Boxes of all sizes, on cell borders, one over the whole page, some without an extent; a document of hundreds and small ones."""
    r = random.Random(6)
    rows = [("big", n, float(x), float(x + w), float(y), float(y + h)) for n, (x, w, y, h) in enumerate((r.randrange(100), r.choice([0, 1, 2, 5]), r.randrange(100), r.choice([1, 2, 5])) for _ in range(300))]
    rows += [("big", 900, 0.0, 100.0, 0.0, 100.0), ("two", 1, 0.0, 1.0, 0.0, 1.0), ("two", 2, 0.5, 1.0, 0.5, 3.0), ("two", 3, None, 1.0, 0.0, 1.0), ("one", 1, 0.0, 1.0, 0.0, 1.0)]
    want = {(d, a[1], b[1]) for a in rows for b in rows for d in [a[0]] if d == b[0] and a[1] < b[1] and None not in a[2:] + b[2:] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]}
    out = links.overlap_pairs(spark.createDataFrame(rows, "d string, n long, x0 double, x1 double, y0 double, y1 double"), "d", ["n"], "x0", "x1", "y0", "y1", crowd=crowd)
    got = [(x["d"], x["a"]["n"], x["b"]["n"]) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_folds_keep_groups_and_are_alike(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", *(f"g{k}" for k in range(60)), "huge", "huge"]), int(r.random() < 0.2)) for i in range(1500)]
    f = learning.grouped_folds(spark.createDataFrame(rows, "id long, g string, label int"), "g", label="label", folds=5).collect()
    by, size, ones = {}, [0] * 5, [0] * 5
    for x in f:
        by.setdefault(x["g"], set()).add(x["fold"])
        size[x["fold"]] += 1
        ones[x["fold"]] += x["label"]
    assert len(f) == 1500 and all(len(folds) == 1 for g, folds in by.items() if g) and by[None] == by[""] == set(range(5))
    assert max(size) - min(size) <= 40 and max(ones) - min(ones) <= 12
    # the dealing itself: every group once, and the greedy rest goes where least is
    assert learning.deal([(1, 0, 7), (0, 2, 5)], 3) == {(1, 0): [3, 2, 2], (0, 2): [1, 2, 2]}
    assert learning.grouped_folds(spark.createDataFrame([], "id long, g string, label int"), "g", label="label").count() == 0


def test_metrics_of_each_fold(spark):
    """Scores fixed in tables, against counts by hand."""
    a = spark.createDataFrame([(1, 0.9), (0, 0.6), (0, 0.2), (1, 0.4)], "label int, score double")
    b = spark.createDataFrame([(1, 0.8), (0, 0.1)], "label int, score double")
    got = {x["fold"]: x for x in learning.fold_metrics([a, b], "label").collect()}
    assert {k: (x["test_size"], x["test_passes"], x["tp"], x["fp"], x["fn"], x["tn"]) for k, x in got.items()} == {0: (4, 2, 1, 1, 1, 1), 1: (2, 1, 1, 0, 0, 1), None: (6, 3, 2, 1, 1, 2)}
    assert got[0]["auc"] == 0.75 and got[1]["auc"] == 1.0 and got[None]["accuracy"] == round(4 / 6, 6)


def test_cross_validation_and_holdout_score_each_row_by_others(spark):
    """A number that only tells within its group, and one that tells of all: every fold is scored by a model of the others."""
    r = random.Random(3)
    rows = [(i, f"g{i % 40}", r.gauss(3.0 * (i % 40 % 2), 1.0), i % 40 % 2) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, g string, x double, label int")
    got = {x["fold"]: x for x in learning.grouped_cv(df, "g", ["x"], [], label="label", folds=4).collect()}
    assert set(got) == {0, 1, 2, 3, None} and got[None]["test_size"] == 800 and sum(got[k]["test_size"] for k in range(4)) == 800
    assert all(x["auc"] > 0.95 for x in got.values())
    held = learning.temporal_holdout(df, ["id"], ["x"], [], label="label").head()
    assert held["tp"] + held["fp"] + held["fn"] + held["tn"] == 240 and held["auc"] > 0.95


def test_rare_categories_share_a_slot(spark):
    train = spark.createDataFrame([(1.0, c) for c in ["a", "a", "a", "b", "b", "rare", "once", None]], "x double, c string")
    model = learning.feature_pipeline(["x"], ["c"]).fit(train)
    seen = model.transform(spark.createDataFrame([(1.0, c) for c in ["a", "b", "rare", "once", "new", None]], "x double, c string")).collect()
    hot = {x["c"]: tuple(x["c_hot"].toArray()) for x in seen}
    assert len(hot["a"]) == len(hot["b"]) and hot["a"] != hot["b"] and hot["rare"] == hot["once"] == hot["new"] == hot[None] not in (hot["a"], hot["b"])


def test_rounds_of_a_graph_append(spark):
    """A chain of many nodes, a cycle, a shared child, wrong counts: what the rounds write is in proportion to the rows."""
    n = 24
    edges = [("g", k, k + 1) for k in range(n)] + [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("d", 0, 1), ("d", 0, 2), ("d", 1, 3), ("d", 2, 3)]
    nodes = [("g", k, k - 1 if k else None, 1) for k in range(n + 1)] + [("c", k, None, None) for k in (1, 2, 3)] + [("d", 0, None, 2), ("d", 1, 0, 1), ("d", 2, 0, 5), ("d", 3, 1, None)]
    e, v = spark.createDataFrame(edges, "graph string, src long, dst long"), spark.createDataFrame(nodes, "graph string, node long, parent long, declared long")
    got = sorted(tuple(r) for r in graph.reachable(e, spark.createDataFrame([("g", 5), ("c", 1)], "graph string, node long")).collect())
    assert got == [("c", 1), ("c", 2), ("c", 3)] + [("g", k) for k in range(5, n + 1)]
    got = {tuple(r) for r in graph.tree_audit(v, e).collect()}
    assert got == {("c", k, "cycle") for k in (1, 2, 3)} | {("c", k, "parent") for k in (1, 2, 3)} | {("d", 3, "shared"), ("d", 3, "parent"), ("d", 2, "count")}


def test_listings_are_cut_into_rows(spark):
    rows = [(n, "k" if n < 25 else None, "PASS" if n % 3 else "FAIL") for n in range(40)]
    df = spark.createDataFrame(rows, "e long, k string, v string")
    got = sorted((r["chunk_no"], r["n"], r["passes"], r["events"]) for r in corpus.contradiction_groups(df, "k", "v", "e", chunk=10).collect())
    assert got == [(c, 25, 16, ",".join(map(str, range(10 * c, min(25, 10 * c + 10))))) for c in range(3)]
    got = sorted((r["chunk_no"], r["verdicts"]) for r in corpus.duplicate_sequences(df, "k", "v", ["e"], chunk=10).collect())
    assert got == [(0, "FPPFPPFPPF"), (1, "PPFPPFPPFP"), (2, "PFPPF")]
    replies = spark.createDataFrame([("a", n, "x") for n in range(30)] + [("b", n, "st" if n == 9 else "op" if n == 10 else "x") for n in range(30)] + [("c", 0, None), ("d", 0, "yes")], "d string, n long, t string")
    got = {r["d"]: r["verdict"] for r in verdicts.verdict_from_replies(replies, "d", "t", ["n"], fail="st\nop", passed="yes", chunk=10).collect()}
    assert got == {"a": "UNKNOWN", "b": "FAIL", "c": "UNKNOWN", "d": "PASS"}


def test_compatible_characters(spark):
    """Every character that normalises to another, alone and between letters, against Unicode's own normalisation."""
    import unicodedata

    chars = [c for c in map(chr, (*range(0x20, 0xD800), *range(0xE000, 0x30000))) if unicodedata.normalize("NFKC", c) != c]
    rows = [(n, f"a{c} {c}b") for n, c in enumerate(chars)] + [(-1, None), (-2, ""), (-3, "plain é ß")]
    got = {r["n"]: r["t"] for r in spark.createDataFrame(rows, "n int, t string").select("n", text.compatible(F.col("t")).alias("t")).collect()}
    each = lambda t: t and "".join(unicodedata.normalize("NFKC", c) for c in t)
    assert got == {n: each(t) for n, t in rows} and len(chars) > 3000
    hashes = text.semantic_hash(spark.createDataFrame([("№\u00a01２", 0), ("No 12", 1), ("no  12", 2), ("ﬁne", 3), ("fine", 4)], "t string, n int"), "t")
    h = {r["n"]: r["semantic"] for r in hashes.collect()}
    assert h[0] == h[1] == h[2] and h[3] == h[4] != h[0]


def test_whole_texts_are_normalised(spark):
    """Letters with marks behind them, marks in any order, halfwidth and Hangul parts, against Unicode's own normalisation; one long run of marks."""
    import unicodedata

    r = random.Random(3)
    pool = ["a", "e", "и", "Е", "é", "ﬁ", "１", "\u0301", "\u0323", "\u0306", "\u0308", "\u0340", "ｶ", "ﾞ", "\u1100", "\u1161", "\u11a8", "가", "\u00a8", "\u09c7", "\u09be", "😀", " ", "\n"]
    rows = [(n, "".join(r.choices(pool, k=r.randint(1, 12)))) for n in range(3000)]
    rows += [(-1, None), (-2, ""), (-3, "и\u0306" * 3), (-4, "a" + "\u0323\u0301" * 100_000)]
    rows += [(5000 + n, f"a{c}") for n, c in enumerate(map(chr, range(0x80, 0xD800))) if unicodedata.normalize("NFKC", f"a{c}") != f"a{c}"]
    got = {x["n"]: x["t"] for x in spark.createDataFrame(rows, "n int, t string").select("n", text.normalized(F.col("t")).alias("t")).collect()}
    assert got == {n: t and unicodedata.normalize("NFKC", t) for n, t in rows}
    h = {x["n"]: x["semantic"] for x in text.semantic_hash(spark.createDataFrame([("и\u0306о", 0), ("йо", 1), ("ио", 2)], "t string, n int"), "t").collect()}
    assert h[0] == h[1] != h[2]


def test_longest_suffix(spark):
    rows = [("a@mail.shop.co.uk", "shop.co.uk"), ("https://x.y.example.com/p", "example.com"), ("b@co.uk", "co.uk"), ("c@uk", "uk"), ("d@a.b.unknown", "b.unknown"), ("nothing", ""), (None, None), ("e@Shop.CO.UK", "shop.co.uk")]
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("CO.uk",), ("com",)], "suffix string")
    got = {r["a"]: r["registered"] for r in text.domain_functions(spark.createDataFrame([(a,) for a, _ in rows], "a string"), "a", suffixes=suffixes).collect()}
    assert got == dict(rows)


def test_dates_behind_labels_and_in_words(spark):
    rows = [(1, "made 01.01.2001\nPaid: 02.03.2024 10:11"), (2, "paid: nothing, on 3 March 2024"), (3, "5 мая 2024, 06:07:08"), (4, "99.99.2024"), (5, ""), (6, None), (7, "paid: 31.02.2024 and 01.02.2024")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.printed_at and r.printed_at.isoformat() for r in text.parse_datetimes(df, "t", labels=["Paid:"], months={"mar": 3, "ма": 5}).collect()}
    assert got == {1: "2024-03-02T10:11:00", 2: "2024-03-03T00:00:00", 3: "2024-05-05T06:07:08", 4: None, 5: None, 6: None, 7: None}


def test_first_three_amounts_that_do_not_add_up(spark):
    rows = [(1, [100.0, 10.0, 110.0, 5.0, 116.0]), (2, [100.0, 10.0, 110.04]), (3, [100.0, 200.0, 301.0]), (4, [100.0, None, 110.0]), (5, [1.0]), (6, []), (7, None)]
    got = {r.id: r.first_mismatch for r in text.amount_triples(spark.createDataFrame(rows, "id int, a array<double>"), "a").collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_marks_of_made_up_text(spark):
    rows = [(1, "xx abcdez bc 1-2-3 кщтр абвг"), (2, "ab 6161"), (3, "cba 6666 6161x7"), (4, "")]
    got = {r.id: (r.consonant_run, r.alphabet_run, r.ascending_digits, r.abab_tail) for r in text.text_artifact_scores(spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    assert got == {1: (4, 5, 2, False), 2: (1, 2, 0, True), 3: (2, 0, 0, False), 4: (0, 0, 0, False)}


def test_pairs_of_masked_cards(spark):
    rows = [(1, "2200 **** 6161 to 9900****1234"), (2, "4111 11****** 5555"), (3, "none"), (4, None)]
    got = {r.id: (r.cards, r.card_head, r.second_tail, r.prefix_ok, r.abab_tail) for r in text.card_masks(spark.createDataFrame(rows, "id int, t string"), "t", ["22", "4"]).collect()}
    assert got[1] == (2, "2200", "1234", False, True) and got[2] == (1, "4111", None, True, False) and got[3] == (0, None, None, None, False)
    assert got[4][1:] == (None, None, None, None)


def test_typography_of_amounts(spark):
    rows = [(1, "10,00 RUR\u00a0\n5,00 RUR"), (2, "10,00 RUR\u00a0\u00a0"), (3, "1 000,00 RUR"), (4, "")]
    got = {r.id: (r.padded, r.uneven_trail, r.grouped) for r in text.amount_typography(spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    assert got == {1: (0, True, 0), 2: (1, False, 0), 3: (0, False, 1), 4: (0, False, 0)}


def test_thin_fonts_have_their_own_threshold(spark):
    items = spark.createDataFrame([(1, "A", c, "x") for c in "abc"] + [(2, "B", c, "x") for c in "abc"] + [(3, "A", "a", "ok")], "d int, f string, c string, h string")
    library = spark.createDataFrame([(f, c, ["ok"]) for f in "AB" for c in "abc"] + [("C", "a", ["ok"])], "f string, c string, hashes array<string>")
    samples = spark.createDataFrame([("A", 9), ("B", 2)], "f string, samples int")
    out = corpus.library_drift(items, "d", "f", "c", "h", library, min_n=3, min_bad=3, ratio=0.5, strict=(4, 4, 0.5), samples=samples, min_samples=5)
    assert {r.d: (r.compared, r.thin_compared, r.drift) for r in out.collect()} == {1: (3, 0, True), 2: (0, 3, False), 3: (1, 0, False)}
    assert sorted(map(tuple, corpus.missing_fonts(items, "d", "f", library).collect())) == [(1, "B"), (1, "C"), (2, "A"), (2, "C"), (3, "B"), (3, "C")]


def test_templates_allow_ranges_and_modes(spark):
    docs = spark.createDataFrame([(1, 10.0, "p"), (2, 11.0, "q"), (3, 50.0, "p"), (4, None, None)], "d int, x double, m string")
    t = spark.createDataFrame([("a", 10.0, 9.0, 10.0, ["p"])], "template string, at double, x_lo double, x_hi double, m_modes array<string>")
    got = {r.d: (r.template, r.breaks) for r in links.template_check(docs, "d", "x", t, tol=2, ranges=["x"], modes=["m"]).collect()}
    assert got == {1: ("a", []), 2: ("a", ["x", "m"]), 3: (None, []), 4: (None, [])}


def test_rules_of_identity_are_not_ranked(spark):
    docs = spark.createDataFrame([(i, i % 2 == 0) for i in range(8)], "d int, bad boolean")
    flags = spark.createDataFrame([(i, c) for i in range(8) for c in ("KNOWN", "SHAPE")], "d int, code string")
    out = corpus.rule_ranking(docs, flags, doc="d", failed=F.col("bad"), identity=["KNOWN"])
    assert [r.code for r in out.collect()] == ["SHAPE"]


@pytest.mark.parametrize("n", [1, 2, 3, 10])
def test_seen_recently_is_a_list_of_n_hashes(spark, n):
    """Against the list itself: a hash seen again keeps its place; null hashes are one hash, null keys one key, other columns stay."""
    r = random.Random(n)
    rows = [(i, r.choice(["u", "v", None]), r.choice([None, "", "a", "b", "c", "d", "e"]), r.choice([None, 1.5])) for i in range(400)]
    lists, want = {}, {}
    for i, user, h, _ in rows:
        recent, h = lists.setdefault(user, []), h or ""
        want[i] = h in recent
        if h not in recent:
            recent.append(h)
            del recent[:-n]
    df = spark.createDataFrame(rows, "i long, u string, h string, seen_recently double")
    got = history.seen_recently(df.repartition(5), "h", ["i"], partition=["u"], n=n)
    assert got.columns == ["i", "u", "h", "seen_recently"] and {x["i"]: x["seen_recently"] for x in got.collect()} == want
    assert history.seen_recently(df.limit(0), "h", ["i"], partition=["u"], n=n).count() == 0


def test_logistic_model_is_balanced(spark):
    """At the best intercept, which no penalty touches, the weighted scores of both labels even out."""
    r = random.Random(5)
    rows = [(i, int(i % 5 == 0), r.gauss(i % 5 == 0, 1.0), r.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, label int, x double, c string")
    scored = learning.fit_predict(df, df, ["x"], ["c"], label="label").collect()
    by = {y: [x["score"] for x in scored if x["label"] == y] for y in (0, 1)}
    assert len(scored) == 400 and abs(sum(by[1]) / len(by[1]) + sum(by[0]) / len(by[0]) - 1) < 1e-3 and sum(by[1]) / len(by[1]) > 0.55
