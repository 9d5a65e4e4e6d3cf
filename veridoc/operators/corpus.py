"""Summaries of a history, reference corpora built from trusted documents, and how rules and scores do against labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.session import cut, known


def corpus_summary(df: DataFrame, *, verdict: str, hash_col: str, reliable: Column) -> DataFrame:
    """One row: rows, passes, fails, rows without a hash, reliable rows, distinct hashes."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col(verdict) == "PASS").alias("passes"), F.count_if(F.col(verdict) == "FAIL").alias("fails"),
        F.count_if(F.col(hash_col).isNull()).alias("missing"), F.count_if(reliable).alias("reliable"), F.countDistinct(hash_col).alias("distinct_hashes"),
    )


def _in_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column, chunk: int) -> DataFrame:
    """(keys, chunk_no, parts): `part` of each row of a key in order, in arrays of `chunk` at most, so that no row grows with its key."""
    numbered = df.select(*keys, part.alias("_v"), (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("_n"))
    return numbered.groupBy(*keys, F.floor(F.col("_n") / chunk).alias("chunk_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias("parts"))


#: Events or verdicts in one row of a listing.
CHUNK = 1000


def contradiction_groups(df: DataFrame, key: str, verdict: str, event: str, *, chunk: int = CHUNK) -> DataFrame:
    """(key, n, passes, fails, chunk_no, events): keys with more than one verdict, with their events in order, `chunk` in a row; a key with more has further rows."""
    rows = df.filter(F.col(key).isNotNull())
    groups = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col(verdict) == "PASS").alias("passes"), F.count_if(F.col(verdict) == "FAIL").alias("fails"), F.min(verdict).alias("_lo"), F.max(verdict).alias("_hi"),
    ).filter("_lo != _hi").drop("_lo", "_hi")
    told = _in_rows(rows.join(groups.select(key), key, "left_semi"), [key], [event], F.col(event).cast("string"), chunk)
    return told.join(groups, key).select(key, "n", "passes", "fails", "chunk_no", F.array_join("parts", ",").alias("events"))


def pass_rate_by(df: DataFrame, key: str, passed: Column) -> DataFrame:
    out = df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(passed).alias("passes"), F.count_if(~passed).alias("fails"))
    return out.withColumn("pass_rate", F.round(F.col("passes") / F.col("total"), 6))


def numeric_bins(df: DataFrame, col: str, edges: Sequence[float], passed: Column) -> DataFrame:
    """(lo, hi, n, passes): counts of the bins (lo, hi]; empty bins and values outside are left out."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        b = F.when((F.col(col) > edges[i]) & (F.col(col) <= edges[i + 1]), i).otherwise(b)
    at = F.array(*[F.lit(float(e)) for e in edges])
    out = df.withColumn("_b", b).filter("_b is not null").groupBy("_b").agg(F.count("*").alias("n"), F.count_if(passed).alias("passes"))
    return out.select(F.get(at, "_b").alias("lo"), F.get(at, F.col("_b") + 1).alias("hi"), "n", "passes")


def duplicate_sequences(df: DataFrame, key: str, verdict: str, order: Sequence[str], *, chunk: int = CHUNK) -> DataFrame:
    """(key, n, chunk_no, verdicts): keys seen twice or more, with the first letters of their verdicts in order, `chunk` in a row. Rows without a key are no group."""
    rows = df.filter(known(key))
    groups = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n >= 2")
    told = _in_rows(rows.join(groups.select(key), key, "left_semi"), [key], order, F.substring(verdict, 1, 1), chunk)
    return told.join(groups, key).select(key, "n", "chunk_no", F.array_join("parts", "").alias("verdicts"))


def one_label_per_doc(df: DataFrame, doc: str, verdict: str) -> DataFrame:
    """(doc, verdict): documents that only ever got one verdict."""
    return df.groupBy(doc).agg(F.min(verdict).alias("verdict"), F.max(verdict).alias("_z")).filter("verdict = _z").drop("_z")


def rule_ranking(docs: DataFrame, flags: DataFrame, *, doc: str, failed: Column, min_support: int = 3, identity: Sequence[str] = ()) -> DataFrame:
    """Per rule with enough support that isn't one of the `identity` rules (known files, which tell nothing of others): fail rates with and without it, their difference, the odds ratio with 0.5 added to each
    cell, and whether it separates perfectly. `docs` has one label for each document."""
    labelled = docs.select(doc, failed.alias("_f"))
    totals = labelled.agg(F.struct(F.count("*").alias("n"), F.count_if("_f").alias("fails"))).scalar()
    per = flags.filter(~F.col("code").isin(*identity)).select(doc, "code").distinct().join(labelled, doc).groupBy("code").agg(F.count("*").alias("support"), F.count_if("_f").alias("hits")).filter(F.col("support") >= min_support)
    x = per.withColumn("_t", totals).select("*", F.col("_t.n").alias("_n"), F.col("_t.fails").alias("_fails"))
    a, b = F.col("hits"), F.col("support") - F.col("hits")
    c, d = F.col("_fails") - F.col("hits"), F.col("_n") - F.col("support") - F.col("_fails") + F.col("hits")
    with_rate, without = a / F.col("support"), F.when(F.col("_n") > F.col("support"), c / (F.col("_n") - F.col("support")))
    return x.select(
        "code", "support", F.round(with_rate, 6).alias("fail_rate_with"), F.round(without, 6).alias("fail_rate_without"), F.round(with_rate - without, 6).alias("delta"),
        F.round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6).alias("odds_ratio"), (((b == 0) & (c == 0)) | ((a == 0) & (d == 0))).alias("separates"),
    )


def running_sums(df: DataFrame, order: Column, sums: Mapping[str, str]) -> DataFrame:
    """Sums of columns up to each row: ranges are summed alone, and start from the totals of those before. No task sees all rows."""
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    local = Window.partitionBy("_part").orderBy(order)
    out = ranged.join(starts, "_part")
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_s_{c}") + F.sum(c).over(local))
    return out.drop("_part", *[f"_s_{c}" for c in sums])


def binary_metrics(df: DataFrame, label: str, score: str, *, threshold: float = 0.5) -> DataFrame:
    """One row: confusion counts, accuracy, balanced accuracy, precision, recall, F1, ROC AUC, average precision, majority baseline.

    Scores are counted by distinct value first, so the curves need a row for each value, not for each document;
    what runs over them is summed in two levels.
    """
    y, s = F.col(label) == 1, F.col(score)
    by = df.filter(s.isNotNull() & F.col(label).isNotNull()).groupBy(s.alias("_s")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    cum = running_sums(by, F.desc("_s"), {"p": "tp", "n": "fp"})
    out = cum.agg(
        F.sum("p").alias("_P"), F.sum("n").alias("_N"),
        F.sum(F.when(F.col("_s") >= threshold, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("_s") >= threshold, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("_auc"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
    )
    P, N, tp, fp = (F.col(c) for c in ("_P", "_N", "tp", "fp"))
    r = lambda c: F.round(c, 6)
    nz = lambda a, b: F.when(b > 0, a / b)
    return out.select(
        "tp", "fp", (P - tp).alias("fn"), (N - fp).alias("tn"), r((tp + N - fp) / (P + N)).alias("accuracy"), r((nz(tp, P) + nz(N - fp, N)) / 2).alias("balanced_accuracy"),
        r(nz(tp, tp + fp)).alias("precision"), r(nz(tp, P)).alias("recall"), r(nz(2 * tp, 2 * tp + fp + P - tp)).alias("f1"), r(nz(F.col("_auc"), P * N)).alias("auc"), r(nz(F.col("_ap"), P)).alias("average_precision"), r(F.greatest(P, N) / (P + N)).alias("majority"),
    )


def _long(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*group, F.explode(pairs).alias("_m")).select(*group, "_m.*")


def build_envelopes(df: DataFrame, group: Sequence[str], metrics: Sequence[str], *, pad: float = 0.0) -> DataFrame:
    """(group, metric, lo, hi): each metric's range, padded, not below 0."""
    return _long(df, group, metrics).filter("value is not null").groupBy(*group, "metric").agg(F.greatest(F.lit(0.0), F.min("value") - pad).alias("lo"), (F.max("value") + pad).alias("hi"))


def envelope_check(df: DataFrame, doc: str, bank: str, channel: str, metrics: Sequence[str], envelopes: DataFrame) -> DataFrame:
    """(doc, metric, value, lo, hi): metrics outside their envelope (bank, channel, metric, lo, hi); the bank's row with a null channel
    stands in for a channel without one, and what has no envelope passes."""
    e = envelopes.select(F.col("bank").alias("_b"), F.col("channel").alias("_c"), F.col("metric").alias("_m"), "lo", "hi")
    own = e.filter("_c is not null")
    any_channel = e.filter("_c is null").select(F.col("_b").alias("_b2"), F.col("_m").alias("_m2"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    x = _long(df, [doc, bank, channel], metrics).filter("value is not null")
    x = x.join(own, (x[bank] == own["_b"]) & (x[channel] == own["_c"]) & (x["metric"] == own["_m"]), "left").join(any_channel, (x[bank] == any_channel["_b2"]) & (x["metric"] == any_channel["_m2"]), "left")
    lo, hi = F.coalesce("lo", "_lo"), F.coalesce("hi", "_hi")
    return x.filter(~F.col("value").between(lo, hi)).select(doc, "metric", "value", lo.alias("lo"), hi.alias("hi"))


def build_profiles(df: DataFrame, group: str, *, sets: Mapping[str, str], sums: Mapping[str, str] = {}, chunk: int = CHUNK) -> DataFrame:
    """(group, n, sums, name, chunk_no, values): each group's number of rows and sums, and the sorted distinct values of each column of `sets` by its
    name, `chunk` in a row; a set with more has further rows, a group without any value one with a null name. Rows without a group are one."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(name) for name, c in sums.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("value")) for name, c in sets.items()])
    distinct = df.select(group, F.explode(pairs).alias("_p")).select(group, "_p.*").filter("value is not null").distinct()
    told = _in_rows(distinct, [group, "name"], ["value"], F.col("value"), chunk).select(F.col(group).alias("_g"), "name", "chunk_no", F.array_join("parts", ",").alias("values"))
    return counts.join(told, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def build_pools(df: DataFrame, group: str, layers: Sequence[str]) -> DataFrame:
    """(group, layer, value, n): the values that each layer has in a group's trusted documents."""
    pairs = F.array(*[F.struct(F.lit(m).alias("layer"), F.col(m).cast("string").alias("value")) for m in layers])
    return df.select(group, F.explode(pairs).alias("_l")).select(group, "_l.*").filter("value is not null").groupBy(group, "layer", "value").agg(F.count("*").alias("n"))


def pool_membership(df: DataFrame, doc: str, group: str, layers: Sequence[str], pools: DataFrame, wholes: DataFrame | None = None) -> DataFrame:
    """(doc, unknown_layers, all_unknown): layers whose value the group's pool lacks; only documents with all of them unknown are suspect.

    With `wholes` (group, layers) also `whole_known`: whether all layers' values stand together there, nulls as values.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("layer"), F.col(m).cast("string").alias("value")) for m in layers])
    whole = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in (group, *layers)])).alias("_w")
    long = df.select(doc, group, whole, F.explode(pairs).alias("_l")).select(doc, group, "_w", "_l.*")
    known = pools.select(group, "layer", "value", F.lit(True).alias("_known")).distinct()
    seen = long.join(known, [group, "layer", "value"], "left")
    unknown = [F.count_if(F.col("_known").isNull()).alias("unknown_layers"), F.bool_and(F.col("_known").isNull()).alias("all_unknown")]
    if wholes is None:
        return seen.groupBy(doc).agg(*unknown)
    seen = seen.join(wholes.select(whole).distinct().withColumn("_whole", F.lit(True)), "_w", "left")
    return seen.groupBy(doc).agg(*unknown, F.bool_or(F.col("_whole").isNotNull()).alias("whole_known"))


def build_library(items: DataFrame, font: str, char: str, hash_col: str) -> DataFrame:
    """(font, char, hashes): what hashes each character of a font has in the corpus, sorted."""
    return items.groupBy(font, char).agg(F.array_sort(F.collect_set(hash_col)).alias("hashes"))


def library_drift(
    items: DataFrame, doc: str, font: str, char: str, hash_col: str, library: DataFrame, *, min_n: int = 12, min_bad: int = 3, ratio: float = 0.2,
    strict: tuple[int, int, float] | None = None, samples: DataFrame | None = None, min_samples: int = 0,
) -> DataFrame:
    """(doc, compared, unknown, drift): items whose character the library knows with other hashes only.

    With `samples` (font, samples) only fonts with `min_samples` of them are held by the first threshold; items of the others are
    counted apart (`thin_compared`, `thin_unknown`) and held by the `strict` one (items, unknown ones, their share).
    """
    x = items.join(library, [font, char]).withColumn("_bad", ~F.array_contains("hashes", F.col(hash_col)))
    over = lambda n, bad, a, b, r: (F.col(n) >= a) & (F.col(bad) >= b) & (F.col(bad) / F.greatest(F.col(n), F.lit(1)) >= r)
    drift = over("compared", "unknown", min_n, min_bad, ratio)
    if samples is None:
        return x.groupBy(doc).agg(F.count("*").alias("compared"), F.count_if("_bad").alias("unknown")).withColumn("drift", drift)
    thin = F.coalesce(F.col("_samples"), F.lit(0)) < min_samples
    x = x.join(samples.select(font, F.col("samples").alias("_samples")), font, "left")
    out = x.groupBy(doc).agg(F.count_if(~thin).alias("compared"), F.count_if(~thin & F.col("_bad")).alias("unknown"), F.count_if(thin).alias("thin_compared"), F.count_if(thin & F.col("_bad")).alias("thin_unknown"))
    return out.withColumn("drift", drift | over("thin_compared", "thin_unknown", *strict) if strict else drift)


#: Fonts of a library that each document is held against.
MAX_FONTS = 10_000


def missing_fonts(items: DataFrame, doc: str, font: str, library: DataFrame) -> DataFrame:
    """(doc, font): fonts of the library that a document lacks. The library's fonts are one row, of MAX_FONTS at most."""
    if library.select(font).distinct().limit(MAX_FONTS + 1).count() > MAX_FONTS:
        raise ValueError(f"a library holds {MAX_FONTS} fonts at most")
    fonts = library.agg(F.collect_set(font)).scalar()
    own = items.groupBy(doc).agg(F.collect_set(font).alias("_own"))
    return own.select(doc, F.explode(F.array_except(fonts, F.col("_own"))).alias(font))


def build_epochs(df: DataFrame, profile: str, date: str) -> DataFrame:
    """(profile, first_date, last_date, samples, dates)."""
    return df.groupBy(profile).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("samples"), F.countDistinct(date).alias("dates"))


def profile_epoch(df: DataFrame, doc: str, profile: str, id_date: str, doc_date: str, epochs: DataFrame, *, min_samples: int = 5, early_days: int = 14, late_days: int = 21) -> DataFrame:
    """(doc, epoch): "early" where both dates are so many days before a well sampled profile's first, "late" where both are past its last
    and the corpus goes on that long, else "inside". Unknown profiles are silent."""
    x = df.join(epochs, profile).withColumn("_end", epochs.agg(F.max("last_date")).scalar())
    first, last = F.col("first_date"), F.col("last_date")
    early = (F.col("samples") >= min_samples) & (F.datediff(first, id_date) >= early_days) & (F.datediff(first, doc_date) >= early_days)
    late = (F.datediff(id_date, last) > late_days) & (F.datediff(doc_date, last) > late_days) & (F.date_add(last, late_days) <= F.col("_end"))
    return x.select(doc, F.when(early, "early").when(late, "late").otherwise("inside").alias("epoch"))


def enroll_original(new: DataFrame, pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pools with the fingerprints of `new` that they lack."""
    fresh = new.select(*pools.columns).dropDuplicates(list(keys)).join(pools, list(keys), "left_anti")
    return pools.unionByName(fresh)


def learn_dependencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): keys that go with exactly one value."""
    return df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_z"), F.count("*").alias("n")).filter(F.col(value) == F.col("_z")).drop("_z")


def dependency_check(df: DataFrame, key: str, payload: str, known: DataFrame) -> DataFrame:
    """Rows whose key is known with other payloads only; unknown keys and null payloads are silent. Rows that repeat are told again."""
    pairs = known.select(key, payload).dropna()
    return df.filter(F.col(payload).isNotNull()).join(pairs.select(key), key, "left_semi").join(pairs, [key, payload], "left_anti").select(*df.columns)


def build_slot_canon(items: DataFrame, owner: str, slot: str, content: str) -> DataFrame:
    """(owner, slot, content): contents that only one owner has in a slot."""
    return items.groupBy(slot, content).agg(F.min(owner).alias(owner), F.max(owner).alias("_z")).filter(F.col(owner) == F.col("_z")).select(owner, slot, content)


def slot_transplant(items: DataFrame, doc: str, owner: str, slot: str, content: str, canon: DataFrame) -> DataFrame:
    """(doc, slot, content, canon_owner, displaced): items that carry what another owner's canon has; `displaced` where the canon has
    contents of the item's own owner in that slot too, which the item then lacks."""
    c = canon.select(F.col(owner).alias("canon_owner"), slot, content)
    x = items.join(c, [slot, content]).filter(F.col("canon_owner") != F.col(owner))
    own = canon.select(owner, slot, F.lit(True).alias("_own")).distinct()
    return x.join(own, [owner, slot], "left").select(doc, slot, content, "canon_owner", F.col("_own").isNotNull().alias("displaced")).distinct()


def build_registry(parts: DataFrame, id_col: str, path: str, part_hash: str) -> DataFrame:
    """(id, path, parts): for each id the parts of its last path, sorted."""
    last = parts.groupBy(id_col).agg(F.max(path).alias(path))
    return parts.join(last, [id_col, path]).groupBy(id_col, path).agg(F.array_join(F.array_sort(F.collect_set(part_hash)), ",").alias("parts"))


def positional_freq(df: DataFrame, id_col: str, slots: Sequence[tuple[str, int, int]], *, distinct: bool = False) -> DataFrame:
    """(slot, value, n): how often each value stands in each slot (name, from, length) of the ids."""
    ids = df.select(id_col).distinct() if distinct else df.select(id_col)
    cells = F.array(*[F.struct(F.lit(name).alias("slot"), F.substring(id_col, a, n).alias("value")) for name, a, n in slots])
    return ids.select(F.explode(cells).alias("_c")).select("_c.*").groupBy("slot", "value").agg(F.count("*").alias("n"))


def usage_kpis(users: DataFrame, checks: DataFrame, *, user: str, ts: str, fake: Column, day: str) -> DataFrame:
    """One row: users, active today, checks and fakes today and in all."""
    today = F.to_date(ts) == F.lit(day).cast("date")
    c = checks.agg(F.countDistinct(F.when(today, F.col(user))).alias("active_today"), F.count_if(today).alias("checks_today"), F.count_if(today & fake).alias("fakes_today"), F.count("*").alias("checks_total"), F.count_if(fake).alias("fakes_total"))
    return c.select(users.agg(F.countDistinct(user)).scalar().alias("users"), "*")


def bank_today_top(checks: DataFrame, bank: str, ts: str, *, day: str, k: int = 8) -> DataFrame:
    """The k banks with most checks that day."""
    return checks.filter(F.to_date(ts) == F.lit(day).cast("date")).groupBy(bank).agg(F.count("*").alias("checks")).orderBy(F.desc("checks"), bank).limit(k)


def cluster_spread(spans: DataFrame, doc: str, x: str, *, band: float, min_n: int) -> DataFrame:
    """(doc, pin, members, span): the upper median of a document's positions, and the number and spread of those within the band."""
    mid = spans.groupBy(doc).agg(F.array_sort(F.collect_list(x)).alias("_xs")).select(doc, F.get("_xs", F.floor(F.size("_xs") / 2).cast("int")).alias("pin"))
    near = spans.join(mid, doc).filter(F.abs(F.col(x) - F.col("pin")) <= band)
    return near.groupBy(doc, "pin").agg(F.count("*").alias("members"), (F.max(x) - F.min(x)).alias("span")).filter(F.col("members") >= min_n)


def residual_lattice(spans: DataFrame, doc: str, x: str, pin: str, *, q: float, allowed: Sequence[float]) -> DataFrame:
    """(doc, residuals, off_lattice): the distinct residuals to the pin in steps of q (half to even), and how many aren't allowed."""
    r = F.bround((F.col(x) - F.col(pin)) / q) * q
    return spans.select(doc, r.alias("_r")).groupBy(doc).agg(F.countDistinct("_r").alias("residuals"), F.countDistinct(F.when(~F.col("_r").isin(*allowed), F.col("_r"))).alias("off_lattice"))
