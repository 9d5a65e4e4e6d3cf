"""Features of a submission history: what was there before each row.

"Before" follows a total order given by the caller, as a rule (time, id). With `partition` the windows are
per key; without it the history is that of the whole table, and no task sees it all: the rows are cut into ranges
of the order, each range is taken alone, and a table with a row for each range says what the ranges before hand on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions.session import by_known, cut, known


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _over(partition: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` as a table with `_part`, the number of the range of `order` that a row is in; equal rows are in one range."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _handed_on(ranged: DataFrame, *summaries: Column) -> tuple[DataFrame, WindowSpec]:
    """A row for each range with its summaries, and the window of the ranges before it. This is all that one task sees of the whole."""
    return ranged.groupBy("_part").agg(*summaries), _before(Window.orderBy("_part"))


def _running(df: DataFrame, counted: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with `_before_c` for each c of `counted`: its sum over all rows before, by `order`."""
    ranged = _ranges(df, order)
    sums, before = _handed_on(ranged, *[F.sum(c).alias(f"_sum_{c}") for c in counted])
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in counted])
    local = _before(_over(["_part"], order))
    out = ranged.join(starts, "_part").withColumns({f"_before_{c}": F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)) for c in counted})
    return out.drop("_part", *[f"_start_{c}" for c in counted])


def ranges_of_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """`df` as a table with `_key`, the key or "" where it isn't known, and `_part`, the range of (key, order) that a row is in. However many rows one key has, they are cut into ranges too."""
    return _ranges(df.withColumn("_key", F.when(known(key), F.concat(F.lit("="), F.col(key).cast("string"))).otherwise("")), ["_key", *order])


def before_in_key(ranged: DataFrame, order: Sequence[str], **values: tuple[Callable[[Column], Column], str]) -> DataFrame:
    """`ranged` (`ranges_of_key`) with a column for each of `values`, (aggregate, column): the aggregate over the earlier rows of the key, null where there is none.

    The aggregate must be one that can be taken over its own results, as sums, least and greatest values can. It is
    taken in each range of a key alone; the ranges before hand theirs on.
    """
    parts = ranged.groupBy("_key", "_part").agg(*[f(F.col(c)).alias(name) for name, (f, c) in values.items()])
    earlier = _before(_over(["_key"], ["_part"]))
    handed = parts.select("_key", "_part", *[f(F.col(name)).over(earlier).alias(f"_handed_{name}") for name, (f, _) in values.items()])
    local = _before(_over(["_part", "_key"], order))
    met = ranged.join(handed, ["_key", "_part"])
    for name, (f, c) in values.items():
        met = met.withColumn(name, F.aggregate(F.array_compact(F.array(f(F.col(c)).over(local), F.col(f"_handed_{name}"))), F.lit(None).cast(met.schema[f"_handed_{name}"].dataType), _merge(f)))
    return met.drop(*[f"_handed_{name}" for name in values])


def _merge(f: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """What puts two results of an aggregate together."""
    two = {F.sum: lambda a, b: a + b, F.min: F.least, F.max: F.greatest}[f]
    return lambda a, b: F.when(a.isNull(), b).otherwise(two(a, b))


def send_index(df: DataFrame, order: Sequence[str], *, partition: Sequence[str] = (), out: str = "send_index") -> DataFrame:
    """The running number of each row, from 1."""
    if partition:
        return df.withColumn(out, F.row_number().over(_over(partition, order)).cast("long"))
    ranged = _ranges(df, order)
    sizes, before = _handed_on(ranged, F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    local = F.row_number().over(_over(["_part"], order))
    return ranged.join(starts.select("_part", "_start"), "_part").withColumn(out, F.col("_start") + local).drop("_part", "_start")


def _last_before(df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str], *, known_only: bool) -> tuple[DataFrame, Column]:
    """(rows, the value of the row before, or of the last one before that has one): null where there is none. Drop `_part` and `_handed`."""
    if partition:
        return df, F.last(value, ignorenulls=known_only).over(_before(_over(partition, order)))
    ranged = _ranges(df, order)
    # a struct that is null where the range has no such row, so that a last value which is null is told apart
    row = F.struct(F.struct(*order).alias("at"), F.col(value).alias("v"))
    lasts, before = _handed_on(ranged, F.max(F.when(F.col(value).isNotNull(), row) if known_only else row).alias("_last"))
    handed = lasts.select("_part", F.last("_last", ignorenulls=True).over(before)["v"].alias("_handed"))
    own = _before(_over(["_part"], order))
    inside = F.last(value, ignorenulls=known_only).over(own)
    first = inside.isNull() if known_only else F.count("*").over(own) == 0
    return ranged.join(handed, "_part"), F.when(first, F.col("_handed")).otherwise(inside)


def previous_verdict(df: DataFrame, verdict: str, order: Sequence[str], *, partition: Sequence[str] = ()) -> DataFrame:
    """The verdict of the row before; "" for the first, and where that row has none."""
    rows, last = _last_before(df, verdict, order, partition, known_only=False)
    return rows.withColumn("previous_verdict", F.coalesce(last, F.lit(""))).drop("_part", "_handed")


def gap_seconds(df: DataFrame, ts: str, order: Sequence[str], *, partition: Sequence[str] = ()) -> DataFrame:
    """Seconds since the last row before that has a time."""
    rows, last = _last_before(df, ts, order, partition, known_only=True)
    return rows.withColumn("gap_seconds", (_micros(F.col(ts)) - _micros(last)) / 1e6).drop("_part", "_handed")


def prior_window_counts(df: DataFrame, ts: str, verdict: Column, order: Sequence[str], *, partition: Sequence[str] = (), seconds: Sequence[int] = (60, 300)) -> DataFrame:
    """Earlier rows, and passes among them, within so many seconds, both ends included. A row without a time counts none and is counted by none.

    With `partition`: a time frame also holds the rows of the same time that come later and the row itself, and
    those are taken off. Without: each row asks how many rows stand before it, and how many before the time where
    its frame begins; the questions are ordered among the rows as points of time, and answered by one running count.
    So a burst of any size is split over ranges, and no row is copied but for its questions.
    """
    out = df.withColumn("_us", _micros(F.col(ts))).withColumn("_pass", F.coalesce(verdict.cast("long"), F.lit(0)))
    if not partition:
        return _prior_counts(out, order, seconds)
    later = _over([*partition, "_us"], order).rowsBetween(0, Window.unboundedFollowing)
    for s in seconds:
        frame = Window.partitionBy(*partition).orderBy("_us").rangeBetween(-s * 1_000_000, 0)
        timed = F.col("_us").isNotNull()
        out = out.withColumn(f"prior_{s}s", F.when(timed, F.count("*").over(frame) - F.count("*").over(later)).otherwise(F.lit(0)))
        out = out.withColumn(f"prior_pass_{s}s", F.when(timed, F.sum("_pass").over(frame) - F.sum("_pass").over(later)).otherwise(F.lit(0)))
    return out.drop("_us", "_pass")


def _prior_counts(df: DataFrame, order: Sequence[str], seconds: Sequence[int]) -> DataFrame:
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    timed = rows.filter(F.col("_us").isNotNull())
    own = [F.col(c).alias(f"_o{n}") for n, c in enumerate(order)]
    # at one time the questions come before the rows
    points = timed.select("_row", F.lit(0).alias("_asks"), F.col("_us").alias("_at"), F.lit(1).alias("_kind"), *own, F.lit(1).cast("long").alias("n"), F.col("_pass").alias("p"))
    for s in seconds:
        none = [F.lit(None).cast(df.schema[c].dataType).alias(f"_o{n}") for n, c in enumerate(order)]
        points = points.union(timed.select("_row", F.lit(s), F.col("_us") - s * 1_000_000, F.lit(0), *none, F.lit(0).cast("long"), F.lit(0).cast("long")))
    told = _running(points, ["n", "p"], ["_at", "_kind", *[f"_o{n}" for n in range(len(order))], "_row"])
    pick = lambda s, c: F.max(F.when(F.col("_asks") == s, F.col(f"_before_{c}")))
    counts = told.groupBy("_row").agg(*[(pick(0, c) - pick(s, c)).alias(name) for s in seconds for c, name in (("n", f"prior_{s}s"), ("p", f"prior_pass_{s}s"))])
    names = [f"prior_{x}{s}s" for s in seconds for x in ("", "pass_")]
    return rows.join(counts, "_row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).drop("_row", "_us", "_pass")


def prior_same_key(df: DataFrame, keys: Sequence[str], passed: Column, order: Sequence[str]) -> DataFrame:
    """For each key: earlier rows with the same value, passes and fails among them; a row whose `passed` is null is neither. An empty key counts nothing."""
    out = df.withColumn("_row", F.lit(1).cast("long")).withColumn("_pass", F.coalesce(passed.cast("long"), F.lit(0))).withColumn("_fail", F.coalesce((~passed).cast("long"), F.lit(0)))
    for k in keys:
        names = {f"prior_{k}_{what}": col for what, col in (("rows", "_row"), ("passes", "_pass"), ("fails", "_fail"))}
        out = before_in_key(ranges_of_key(out, k, order), order, **{n: (F.sum, c) for n, c in names.items()})
        out = out.withColumns({n: F.when(F.col("_key") != "", F.coalesce(n, F.lit(0))).otherwise(F.lit(0)) for n in names}).drop("_key", "_part")
    return out.drop("_row", "_pass", "_fail")


def first_seen(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time of each key, and how often it was seen."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("seen_count"))


def unique_in_batch(df: DataFrame, hash_col: str, order: Sequence[str]) -> DataFrame:
    """Whether a row is the first of its hash; rows without a hash are like no other. `order` tells rows apart.

    The first of each hash is found by aggregation and met with the rows, so a hash that many rows have is split.
    """
    at = F.struct(*order)
    firsts = df.filter(known(hash_col)).groupBy(F.col(hash_col).alias("_hash")).agg(F.min(at).alias("_first"))
    met = df.filter(known(hash_col)).join(firsts, F.col(hash_col) == F.col("_hash")).withColumn("is_unique", at == F.col("_first"))
    return met.select(*df.columns, "is_unique").unionByName(df.filter(~known(hash_col)).withColumn("is_unique", F.lit(True)))


class _Newest:
    """The newest n values that entered, for one key after another; one that is there keeps its place."""

    def __init__(self, n: int):
        self.n, self.at, self.held, self.asked = n, None, {}, {}

    def meets(self, at: tuple, value: str | None, enters: bool) -> bool:
        """Whether the list of key `at` has the value, which enters it if it hasn't. Null is in no list."""
        if at != self.at:
            self.at, self.held, self.asked = at, {}, {}
        if enters and value is not None and len(self.asked) <= self.n:
            self.asked[value] = None
        if value in self.held:
            return True
        if enters and value is not None:
            self._enter(value)
        return False

    def begin(self, at: tuple, value: str) -> None:
        """A value of the list that key `at` begins with, oldest first."""
        if at != self.at:
            self.at, self.held, self.asked = at, {}, {}
        self._enter(value)

    def _enter(self, value: str) -> None:
        self.held[value] = None
        if len(self.held) > self.n:
            del self.held[next(iter(self.held))]

    def few(self) -> list[str] | None:
        """The values that were to enter, in order, where they are no more than n."""
        return [*self.asked] if len(self.asked) <= self.n else None


def _in_newest(df: DataFrame, value: Column, enters: Column, order: Sequence[str], partition: Sequence[str], n: int, out: str) -> DataFrame:
    """`df` with `out`: whether the list of the newest n values that entered, one list for each key, has the row's value.

    The rows are cut into ranges of (key, order), so a key that most rows have is split too. Each range is walked
    by itself as if its first key's list were empty, and says what its last key's list holds at the end. One pass
    over the ranges hands the lists on. What a range says is right where it has more than one key; where one key
    fills it, values that fit beside those handed on are put behind them, else the range is walked again from the
    list that it was handed, until no such list changes. Lists soon forget where they began, so two rounds are the
    rule; at the worst each round makes one more range right. One task sees 2 n values a range.
    """
    plain = df.drop(out)
    names = plain.columns
    key = F.to_json(F.struct(*partition)) if partition else F.lit("")
    rows = _ranges(plain.select("*", key.alias("_key"), value.alias("_value"), F.coalesce(enters, F.lit(False)).alias("_enters")), ["_key", *order])
    steps = ["_part", "_key", "_value", "_enters", "_seed"]

    def from_lists(ranges: DataFrame, lists: DataFrame) -> DataFrame:
        """The rows of some ranges in order, each range behind the list that it is handed."""
        seeds = lists.select("_part", F.col("_first").alias("_key"), F.posexplode("_handed").alias("_seed", "_value")).withColumn("_enters", F.lit(True))
        both = ranges.withColumn("_seed", F.lit(None).cast("int")).unionByName(seeds, allowMissingColumns=True)
        return both.repartition("_part").sortWithinPartitions("_part", F.col("_seed").asc_nulls_last(), "_key", *order)

    said = pa.schema([("_part", pa.int32()), ("_first", pa.string()), ("_last", pa.string()), ("_list", pa.list_(pa.string())), ("_few", pa.list_(pa.string()))])

    def columns(b: pa.RecordBatch, cols: Sequence[str]) -> Iterator[tuple]:
        return zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in cols), strict=True)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest, part, first = _Newest(n), None, None
        for b in batches:
            done = []
            for p, k, v, e, seed in columns(b, steps):
                if p != part:
                    done.append((part, first, newest))
                    newest, part, first = _Newest(n), p, k
                if seed is None:
                    newest.meets((p, k), v, e)
                else:
                    newest.begin((p, k), v)
            yield told([x for x in done if x[0] is not None])
        if part is not None:
            yield told([(part, first, newest)])

    def told(done: list[tuple]) -> pa.RecordBatch:
        rows = [(p, k, x.at[1], [*x.held], x.few()) for p, k, x in done]
        return pa.RecordBatch.from_pylist([dict(zip(said.names, r, strict=True)) for r in rows], schema=said)

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            handed = []
            for p, first, last, after, few, began in columns(b, [*said.names, "_from"]):
                given = held if key == first else []
                again = False
                if first == last and given != began:
                    more = None if few is None else [*dict.fromkeys([*given, *few])]
                    again = more is None or len(more) > n
                    after = after if again else more
                handed.append({"_part": p, "_handed": given, "_again": again})
                key, held = last, after
            yield pa.RecordBatch.from_pylist(handed, schema=pa.schema([said.field("_part"), ("_handed", pa.list_(pa.string())), ("_again", pa.bool_())]))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest = _Newest(n)
        for b in batches:
            own, met = [], []
            for p, k, v, e, seed in columns(b, steps):
                own.append(seed is None)
                met.append(newest.meets((p, k), v, e) if seed is None else newest.begin((p, k), v))
            kept = pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(met, pa.bool_())], names=[*names, out])
            yield kept.filter(pa.array(own, pa.bool_()))

    def walked(ranges: DataFrame, lists: DataFrame) -> DataFrame:
        return from_lists(ranges, lists).mapInArrow(ends, "_part int, _first string, _last string, _list array<string>, _few array<string>")

    # the columns that only the result needs are not moved in the rounds
    bare = rows.select(*dict.fromkeys(["_part", "_key", "_value", "_enters", *order]))
    nothing = rows.sparkSession.createDataFrame([], "_part int, _first string, _handed array<string>")
    lists = cut(walked(bare, nothing).withColumn("_from", F.expr("cast(array() as array<string>)")))
    while True:
        handed = lists.repartition(1).sortWithinPartitions("_part").mapInArrow(hand_on, "_part int, _handed array<string>, _again boolean")
        handed = cut(handed.join(lists.select("_part", "_first"), "_part"))
        again = handed.filter("_again")
        if again.isEmpty():
            break
        anew = walked(bare.join(again.select("_part"), "_part", "left_semi"), again).join(again.select("_part", F.col("_handed").alias("_from")), "_part")
        lists = cut(lists.join(again.select("_part"), "_part", "left_anti").unionByName(anew))
    kind = T.StructType([*plain.schema.fields, T.StructField(out, T.BooleanType())])
    return from_lists(rows, handed).select(*names, *steps).mapInArrow(flags, kind)


def seen_recently(df: DataFrame, hash_col: str, order: Sequence[str], *, partition: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Whether the hash is in its key's list of n hashes: one that is there keeps its place, one that isn't enters, and the oldest leaves.

    A null hash is the empty one, null keys are one key; without `partition` the whole table has one list. An
    empty table gives no rows. No task holds more than n hashes, nor all rows of a key (`_in_newest`).
    """
    return _in_newest(df, F.coalesce(F.col(hash_col).cast("string"), F.lit("")), F.lit(True), order, partition, n, "seen_recently")


def daily_quota(df: DataFrame, user: str, ts: str, order: Sequence[str], *, limit: int) -> DataFrame:
    """The row's number in its user's day, and whether the quota allows it. A day with most of the rows is counted in ranges."""
    day = df.withColumn("day", F.to_date(ts)).withColumn("_user_day", F.to_json(F.struct(user, "day"))).withColumn("_one", F.lit(1).cast("long"))
    out = before_in_key(ranges_of_key(day, "_user_day", order), order, used=(F.sum, "_one"))
    out = out.withColumn("used", F.coalesce("used", F.lit(0)) + 1).withColumn("allowed", F.col("used") <= limit)
    return out.drop("_user_day", "_one", "_key", "_part")


def clean_streak(df: DataFrame, clean: Column, order: Sequence[str], *, partition: Sequence[str] = (), ids: str | None = None, last: int | None = None) -> DataFrame:
    """Length of the run of clean rows up to each row; any other row resets it to 0, as does one whose `clean` is null.

    With `ids`, a row whose id an earlier clean row has is passed over: it neither counts nor resets. With `last`
    only the ids of the newest so many rows that counted are held against it. Without `partition` each range hands
    on whether it has a reset, and the clean rows after its last one.
    """
    out = df.withColumn("_clean", F.coalesce(clean, F.lit(False))).withColumn("_over", F.lit(False))
    if ids is not None and last is not None:
        out = _in_newest(out, F.when(known(ids), F.col(ids).cast("string")), F.col("_clean"), order, partition, last, "_over")
    elif ids is not None:
        seen = F.count_if("_clean").over(_before(Window.partitionBy(*partition, *by_known(ids, order)).orderBy(*order))) > 0
        out = out.withColumn("_over", known(ids) & seen)
    counts, resets = (F.col("_clean") & ~F.col("_over")).cast("long"), (~F.col("_clean") & ~F.col("_over")).cast("long")
    out = out.withColumn("_one", counts).withColumn("_reset", resets)
    by = list(partition)
    if not partition:
        out, by = _ranges(out, order), ["_part"]
    w = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_island", F.sum("_reset").over(w))
    out = out.withColumn("streak", F.sum("_one").over(_over([*by, "_island"], order).rowsBetween(Window.unboundedPreceding, 0)))
    if not partition:
        at = F.struct("_island", F.struct(*order))
        ranges, before = _handed_on(out, F.max("_island").alias("_resets"), F.max_by("streak", at).alias("_tail"), F.sum("_one").alias("_ones"))
        ranges = ranges.withColumn("_upto", F.sum("_ones").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        # what stands after the last reset: that range's tail, and all ranges between
        open_ = F.last(F.when(F.col("_resets") > 0, F.struct(F.col("_tail") - F.col("_upto"))), ignorenulls=True).over(before)["col1"]
        carry = F.coalesce(F.lag("_upto").over(Window.orderBy("_part")), F.lit(0)) + F.coalesce(open_, F.lit(0))
        out = out.join(ranges.select("_part", carry.alias("_carry")), "_part").withColumn("streak", F.col("streak") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).drop("_part", "_carry")
    return out.drop("_clean", "_over", "_one", "_reset", "_island")


def round_trend(df: DataFrame, round_col: str, values: Sequence[str], *, partition: Sequence[str] = ()) -> DataFrame:
    """The change of each value since the round before, as a number and as up, down or same."""
    w = _over(partition, [round_col])
    for v in values:
        delta = F.col(v) - F.lag(v).over(w)
        df = df.withColumn(f"{v}_delta", delta).withColumn(f"{v}_trend", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same"))
    return df


def adjacent_gaps(items: DataFrame, doc: str, order: Sequence[str], x0: str, x1: str, *, hard: float) -> DataFrame:
    """The gap from each item's end to the next one's start; negative is overlap, past `hard` either way is flagged."""
    gap = F.lead(x0).over(_over([doc], order)) - F.col(x1)
    return items.withColumn("gap", gap).withColumn("hard_gap", F.coalesce(F.abs("gap") > hard, F.lit(False)))


def ascending_run(items: DataFrame, doc: str, order: Sequence[str], value: str) -> DataFrame:
    """(doc, longest_run): the longest run of rows whose value is one more than the row's before."""
    w = _over([doc], order)
    step = F.when(F.col(value) == F.lag(value).over(w) + 1, 0).otherwise(1)
    runs = items.withColumn("_step", step).withColumn("_run", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(doc, "_run").agg(F.count("*").alias("n")).groupBy(doc).agg(F.max("n").alias("longest_run"))


def field_order(df: DataFrame, doc: str, text: str, core: Sequence[str]) -> DataFrame:
    """(doc, missing, in_order): core labels that a text lacks, and whether those it has stand in the given order."""
    at = [F.instr(F.col(text), label) for label in core]
    missing = F.array_join(F.array_compact(F.array(*[F.when(a == 0, F.lit(label)) for a, label in zip(at, core, strict=True)])), ",")
    found = F.filter(F.array(*at), lambda a: a > 0)
    return df.select(doc, missing.alias("missing"), (found == F.array_sort(found)).alias("in_order"))


def reply_attribution(df: DataFrame, is_upload: Column, order: Sequence[str], *, partition: Sequence[str] = ()) -> DataFrame:
    """The number of the upload that each row belongs to; 0 before the first."""
    marked = df.withColumn("_up", F.coalesce(is_upload, F.lit(False)).cast("long"))
    if partition:
        return marked.withColumn("upload_no", F.sum("_up").over(_over(partition, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_up")
    return _running(marked, ["_up"], order).withColumn("upload_no", F.col("_before__up") + F.col("_up")).drop("_up", "_before__up")


def order_signature(items: DataFrame, doc: str, order: Sequence[str], label: str) -> DataFrame:
    """(doc, signature): the hash of a document's labels in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, label)))
    return items.groupBy(doc).agg(F.sha2(F.array_join(listed[label], ">"), 256).alias("signature"))


def latest_name(df: DataFrame, user: str, name: str, order: str) -> DataFrame:
    """(user, latest_name): the newest name of each user that is not null."""
    return df.filter(F.col(name).isNotNull()).groupBy(user).agg(F.max_by(name, order).alias("latest_name"))


def temporal_split(df: DataFrame, order: Sequence[str], *, frac: float = 0.7) -> DataFrame:
    """"train" for the first floor(frac * n) rows, "test" for the rest."""
    first = int(df.count() * frac)
    return send_index(df, order, out="_no").withColumn("split", F.when(F.col("_no") <= first, "train").otherwise("test")).drop("_no")
