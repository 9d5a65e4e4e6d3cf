"""Joins across documents: known items, reuse and conflicts of identities, set operations, retention.

Pairs are made only where pairs are asked for. Null and empty keys go before joins, so they gather nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import comb
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.session import by_known, cut, known
from veridoc.operators.history import before_in_key, ranges_of_key


def _where_known(df: DataFrame, key: str, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`join` of the rows that have the key, and the others beside them: however many lack it, they meet nowhere."""
    return join(df.filter(known(key))).unionByName(df.filter(~known(key)), allowMissingColumns=True)


def log_chat_merge(logs: DataFrame, chat: DataFrame, key: str) -> DataFrame:
    """Logs with the chat's columns where both have the key, and the chat rows without a log. Rows without a key stay as they are."""
    told = chat.drop(*[c for c in chat.columns if c in logs.columns and c != key])
    both = _where_known(logs, key, lambda x: x.join(told.filter(known(key)), key, "left")).withColumn("origin", F.lit("log"))
    only = _where_known(chat, key, lambda x: x.join(logs.filter(known(key)).select(key), key, "left_anti")).withColumn("origin", F.lit("chat"))
    return both.unionByName(only, allowMissingColumns=True)


def log_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns by name; missing ones are null."""
    return a.unionByName(b, allowMissingColumns=True)


def resolve_copy(rows: DataFrame, candidates: DataFrame, key: str, size: str) -> DataFrame:
    """Each row with its best candidate (key, kind, path, size): a chat copy of the right size, a path of the right size, a chat copy, any; of equal ones the first path.

    Candidates are reduced to the best of each key and size, and of each key, before they meet the rows. Every row stays,
    those that share a key too; a row without a key, or whose key no candidate has, gets null. A row without a size fits none.
    """
    best = F.min(F.struct((F.col("kind") != "chat").alias("_other"), F.col("path").isNull().alias("_none"), "path", "kind"))
    c = candidates.filter(known(key))
    fits = c.filter(F.col(size).isNotNull()).groupBy(key, size).agg(best.alias("_fits"))
    some = c.groupBy(key).agg(best.alias("_some"))
    met = _where_known(rows, key, lambda x: x.join(fits, [key, size], "left").join(some, key, "left"))
    chosen = F.coalesce("_fits", "_some")
    return met.select(*rows.columns, chosen["kind"].alias("kind"), chosen["path"].alias("path"))


def known_lookup(df: DataFrame, tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """`known_by` and `known_label`: the first of the registries (key column, its table (key, label)) that knows the row. A key that isn't there is known by none."""
    names, labels = [], []
    for key, registry in tables:
        one = registry.filter(known(key)).groupBy(key).agg(F.min("label").alias(f"_label_{key}"))
        df = _where_known(df, key, lambda x, key=key, one=one: x.join(one, key, "left"))
        names.append(F.when(F.col(f"_label_{key}").isNotNull(), F.lit(key)))
        labels.append(F.col(f"_label_{key}"))
    return df.withColumn("known_by", F.coalesce(*names)).withColumn("known_label", F.coalesce(*labels)).drop(*[f"_label_{k}" for k, _ in tables])


def requisite_blacklist(df: DataFrame, doc: str, keys: str, blacklist: DataFrame) -> DataFrame:
    """(doc, hits): how many of a document's keys (an array) are on the list (key)."""
    return df.select(doc, F.explode(F.array_distinct(keys)).alias("key")).join(blacklist.select("key").distinct(), "key", "left_semi").groupBy(doc).agg(F.count("*").alias("hits"))


def identity_conflict(df: DataFrame, id_col: str, file_hash: str, signature: str, order: Sequence[str]) -> DataFrame:
    """`conflict`: an earlier row of the same id has another file and another signature, id, file and signature being known in both. `order` tells rows apart.

    Six rows of an id are enough to know: its first, (f, s); the first with another file and another signature than that;
    the first with another file, and of those the first with another signature than its own; the same with file and
    signature changed. A row that shares nothing with the first is met by it, one that shares both by the second, one that
    shares the file by the third or, where it has that one's signature, the fourth. They are found by aggregation and
    met with the rows in joins, so an id that a third of all rows have is split.
    """
    whole = known(id_col) & known(file_hash) & known(signature)
    row = F.struct(F.struct(*order).alias("at"), F.col(file_hash).alias("f"), F.col(signature).alias("s"))
    f, s = F.col(file_hash), F.col(signature)
    rows = df.filter(whole)
    key = F.col(id_col).alias("_id")

    def firsts(x: DataFrame, **tests: Column) -> DataFrame:
        return x.groupBy(key).agg(*[F.min(F.when(t, row)).alias(name) for name, t in tests.items()])

    def met(x: DataFrame, found: DataFrame) -> DataFrame:
        return x.join(found, F.col(id_col) == F.col("_id")).drop("_id")

    one = firsts(rows, _r1=F.lit(True))
    other_f, other_s = f != F.col("_r1.f"), s != F.col("_r1.s")
    two = firsts(met(rows, one), _r2=other_f & other_s, _r3=other_f, _r5=other_s)
    both = one.join(two, "_id")
    four = firsts(met(rows, both), _r4=other_f & (s != F.col("_r3.s")), _r6=other_s & (f != F.col("_r5.f")))
    told = met(rows, both.join(four, "_id"))
    nearest = (
        F.when(other_f & other_s, F.col("_r1"))
        .when(~other_f & ~other_s, F.col("_r2"))
        .when(~other_f, F.when(s != F.col("_r3.s"), F.col("_r3")).otherwise(F.col("_r4")))
        .otherwise(F.when(f != F.col("_r5.f"), F.col("_r5")).otherwise(F.col("_r6")))
    )
    told = told.withColumn("conflict", F.coalesce(nearest["at"] < F.struct(*order), F.lit(False))).select(*df.columns, "conflict")
    return told.unionByName(df.filter(~whole).withColumn("conflict", F.lit(False)))


def field_conflicts(df: DataFrame, id_col: str, file_hash: str, fields: Sequence[str], *, dates: Sequence[str] = ()) -> DataFrame:
    """(id, fields): the fields in which files of one id differ, both sides being known; `dates` are compared by day."""
    value = lambda f: F.to_date(f) if f in dates else F.col(f)
    x = df.filter(known(id_col)).groupBy(id_col).agg(F.countDistinct(file_hash).alias("_files"), *[F.countDistinct(F.when(known(f), value(f))).alias(f"_n_{f}") for f in fields])
    named = F.array_compact(F.array(*[F.when(F.col(f"_n_{f}") > 1, F.lit(f)) for f in fields]))
    return x.filter("_files > 1").select(id_col, F.array_join(named, ",").alias("fields")).filter("fields != ''")


def weak_match_once(df: DataFrame, id_col: str, file_hash: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(file, id, differing): files whose id another file had before, once for each file, with the `fields` that differ; "" where none does.

    Fields are held against those of all earlier rows of the id in other files, where both are known. Rows without an id,
    without a file, or without any of the fields tell nothing. Of a file's rows the first that meets another file is told.
    Counted, not paired, as in `identity_conflict`.
    """
    whole = known(id_col) & known(file_hash) & reduce(or_, map(known, fields))

    def others(seen: Column, *by: str) -> Column:
        """Earlier rows of the id, and of the columns `by`, in other files."""
        before = lambda *more: F.count_if(seen).over(Window.partitionBy(*by_known(id_col, order), *by, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return before() - before(file_hash)

    rows = df.filter(whole)
    differ = [F.when(known(f) & (others(known(f)) > others(known(f), f)), F.lit(f)) for f in fields]
    met = rows.withColumn("_others", others(F.lit(True))).withColumn("differing", F.array_join(F.array_compact(F.array(*differ)), ",")).filter("_others > 0")
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(file_hash).orderBy(*order))).filter("_r = 1").select(file_hash, id_col, "differing")


def email_reuse(df: DataFrame, key: str, user: str, order: Sequence[str], ts: str) -> DataFrame:
    """For each use of a key: its number, the first time, and whether another user had it before. A key of any number of uses is cut into ranges."""
    ranged = ranges_of_key(df.filter(known(key)).withColumn("_one", F.lit(1).cast("long")), key, order)
    firsts = ranged.groupBy("_key").agg(F.min_by(ts, F.struct(*order)).alias("first_time"))
    out = before_in_key(ranged, order, _uses=(F.sum, "_one"), _least=(F.min, user), _most=(F.max, user)).join(firsts, "_key")
    other = (F.col("_least") != F.col(user)) | (F.col("_most") != F.col(user))
    return out.select(*df.columns, (F.coalesce("_uses", F.lit(0)) + 1).alias("use_no"), "first_time", F.coalesce(other, F.lit(False)).alias("by_other"))


def stem_reuse(df: DataFrame, doc: str, stem: str, tail: str, id_col: str, date: str, stems: DataFrame) -> DataFrame:
    """(doc): documents whose stem is known, but with a tail, an id and a date that are all new to it. What a document lacks isn't new."""
    out = df.filter(known(stem) & known(tail) & known(id_col) & F.col(date).isNotNull())
    out = out.join(stems.select(stem).distinct(), stem, "left_semi")
    for c in (tail, id_col, date):
        out = out.join(stems.select(stem, c).distinct(), [stem, c], "left_anti")
    return out.select(doc)


def linked_tuple(df: DataFrame, key: str, pair: Sequence[str], allowed: DataFrame) -> DataFrame:
    """Rows whose (key, pair) isn't allowed, with `owner`: the only key that the pair is allowed for, if there is one."""
    owners = allowed.groupBy(*pair).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    bad = df.join(allowed.select(key, *pair).distinct(), [key, *pair], "left_anti").join(owners, list(pair), "left")
    return bad.withColumn("owner", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).drop("_lo", "_hi")


#: Documents that may meet a registered one by one part; where more do, it is looked up by several parts at once, so many at most.
CROWD, DEEPEST = 1000, 5

#: Combinations of parts that one document is looked up by, for each number of parts.
COMBINED = 1000


def _choices(df: DataFrame, most: int) -> DataFrame:
    """A row for each choice of `_n` (`most` at most) from the array `_ids`, as a hash `_key` of them in their order; `_k` and `_n` go into it."""
    df = df.filter(F.size("_ids") >= F.col("_n")).withColumns({"_ids": F.sort_array("_ids"), "_at": F.lit(-1), "_key": F.xxhash64("_k", "_n")})
    for i in range(most):
        more, places = F.col("_n") > i, F.sequence(F.col("_at") + 1, F.size("_ids") - F.col("_n") + i)
        df = df.withColumn("_at", F.explode(F.when(more, places).otherwise(F.array("_at"))))
        df = df.withColumn("_key", F.when(more, F.xxhash64("_key", F.get("_ids", "_at"))).otherwise(F.col("_key")))
    return df.drop("_k", "_n", "_ids", "_at")


def _shell_pairs(parts: DataFrame, refs: DataFrame, doc: str, ref: str, missing: int, crowd: int) -> DataFrame:
    """(doc, ref): all documents that may share all but `missing` parts (_p, _h) of a registered document's `_all`, and few others.

    A document that lacks `missing` of them at most has k of any `missing` + k. So it is looked up by each choice of k
    among the rarest `missing` + k, and what has k parts of those gives each choice of k of its own. k is 1 where
    few documents have the rarest parts. Documents with too many choices are looked up by fewer parts.
    """
    deepest = max(k for k in range(1, DEEPEST + 1) if k == 1 or comb(missing + k, k) <= COMBINED)
    often = parts.groupBy("_p", "_h").agg(F.count("*").alias("_often"))
    pieces = refs.select(ref, F.explode("_all").alias("_piece")).select(ref, "_piece.*").join(often, ["_p", "_h"], "left")
    tops = pieces.groupBy(ref).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)).alias("_often"), "_p", "_h"))).alias("_order"))
    few = F.aggregate(F.slice("_order", 1, missing + 1), F.lit(0).cast("bigint"), lambda out, x: out + x["_often"]) <= crowd
    tops = tops.withColumn("_k", F.when(few, 1).otherwise(F.least(F.size("_order") - missing, F.lit(deepest))))
    tops = cut(tops.select(ref, "_k", F.posexplode(F.slice("_order", F.lit(1), F.col("_k") + missing)).alias("_at", "_piece")).select(ref, "_k", "_at", "_piece._p", "_piece._h"))
    names = cut(tops.groupBy("_p", "_h").agg(F.collect_set("_k").alias("_ks")).withColumn("_id", F.monotonically_increasing_id()))

    asked = tops.join(names.drop("_ks"), ["_p", "_h"]).groupBy(ref, "_k").agg(F.collect_list(F.struct("_at", "_id")).alias("_ids"))
    asked = asked.withColumn("_n", F.explode(F.sequence(F.lit(1), "_k"))).select(ref, "_k", "_n", F.filter("_ids", lambda x: x["_at"] < F.col("_n") + missing)["_id"].alias("_ids"))
    # dealt out as bare ids, not as what is gathered from them
    given = parts.join(names, ["_p", "_h"]).select(doc, F.explode("_ks").alias("_k"), "_id").repartition(doc).groupBy(doc, "_k").agg(F.collect_set("_id").alias("_ids")).filter(F.size("_ids") >= F.col("_k"))
    ways = lambda k: reduce(lambda out, i: out * (F.size("_ids") - i) / (i + 1), range(k), F.lit(1.0))
    given = given.withColumn("_n", F.greatest(F.lit(1), *[F.when((F.col("_k") >= k) & (ways(k) <= COMBINED), k) for k in range(2, deepest + 1)], F.lit(None)))
    asked = cut(_choices(asked, deepest))
    keys = cut(asked.select("_key").distinct())  # where these are few, Spark leaves out all other choices before it deals them out
    return _choices(given, deepest).join(keys, "_key", "left_semi").join(asked, "_key").select(doc, ref).distinct()


def shell_overlap(parts: DataFrame, registry: DataFrame, doc: str, ref: str, part: str, hash_col: str, *, missing: int = 1, least: int = 2, static: Column | None = None, identity: str | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc, ref, shared, total): documents that share all but `missing` at most of a registered document's parts, but not all of their own.

    Registered documents have `least` parts or more. `static` tells the registered parts that must all be
    shared; `identity` is a column of both tables in which the two must differ, both being known. A part without
    a name or a hash is shared with nobody.

    Pairs that may do are found by a few rare parts, or by several common ones at once (where the rarest are in more than
    `crowd` documents), and are then held against each other whole. Registered documents that are alike are one of
    them until the end, so copies of one document that is registered often are no pairs.
    """
    piece = F.struct("_p", "_h")
    named = lambda df, *more: df.select(*more, F.col(part).alias("_p"), F.col(hash_col).alias("_h"))
    whole = lambda c: F.filter(c, lambda x: x["_p"].isNotNull() & x["_h"].isNotNull())
    fixed = F.lit(False) if static is None else F.coalesce(static, F.lit(False))
    who = F.col(identity) if identity else F.lit(None).cast("string")
    own = named(parts, doc, who.alias("_w"))
    kind = ["_all", "_static", "_ref_who"]
    refs = named(registry, ref, who.alias("_w"), fixed.alias("_fixed")).groupBy(ref).agg(F.sort_array(F.collect_set(piece)).alias("_all"), F.sort_array(F.collect_set(F.when(F.col("_fixed"), piece))).alias("_static"), F.max("_w").alias("_ref_who"))
    refs = cut(refs.filter((F.size("_all") > missing) & (F.size("_all") >= least)))
    kinds = cut(refs.select(*kind).distinct().withColumn("_kind", F.monotonically_increasing_id()))
    same = reduce(lambda x, y: x & y, (refs[c].eqNullSafe(kinds[c]) if c == "_ref_who" else refs[c] == kinds[c] for c in kind))
    members = refs.join(kinds, same).select(ref, "_kind")
    met = cut(_shell_pairs(own.select(doc, "_p", "_h"), kinds, doc, "_kind", missing, crowd))
    own = own.join(met.select(doc).distinct(), doc, "left_semi").repartition(doc).groupBy(doc).agg(F.collect_set(piece).alias("_own"), F.max("_w").alias("_who"))
    shared, total = F.size(F.array_intersect(whole("_own"), "_all")), F.size("_all")
    out = met.join(kinds, "_kind").join(own, doc).withColumn("shared", shared.cast("long")).withColumn("total", total.cast("long"))
    out = out.filter((F.col("shared") >= F.col("total") - missing) & ((F.col("shared") < F.col("total")) | (F.col("shared") < F.size("_own"))))
    out = out.filter(F.size(F.array_except("_static", whole("_own"))) == 0)
    out = out.filter("_who != _ref_who") if identity else out
    return out.select(doc, "_kind", "shared", "total").join(members, "_kind").select(doc, ref, "shared", "total")


def latent_revision(versions: DataFrame, container: str, version: str, stable: Sequence[str], dynamic: Sequence[str]) -> DataFrame:
    """(container, fields): containers with versions of one stable identity that differ in dynamic fields."""
    x = versions.groupBy(container, *stable).agg(F.countDistinct(version).alias("_n"), *[F.countDistinct(F.when(known(f), F.col(f))).alias(f"_n_{f}") for f in dynamic])
    named = F.array_compact(F.array(*[F.when(F.col(f"_n_{f}") > 1, F.lit(f)) for f in dynamic]))
    return x.filter("_n > 1").select(container, *stable, F.array_join(named, ",").alias("fields")).filter("fields != ''")


def parser_parity(a: DataFrame, b: DataFrame, doc: str, field: str, value: str) -> DataFrame:
    """(doc, field, a, b): fields that both extractors found, with other values."""
    return a.select(doc, field, F.col(value).alias("a")).join(b.select(doc, field, F.col(value).alias("b")), [doc, field]).filter(known("a") & known("b") & (F.col("a") != F.col("b")))


def novelty_observe(df: DataFrame, keys: Sequence[str], ts: str, atlas: DataFrame) -> DataFrame:
    """(keys, sightings, first_seen, last_seen): combinations that the atlas lacks. They are observations, never evidence."""
    return df.join(atlas, list(keys), "left_anti").groupBy(*keys).agg(F.count("*").alias("sightings"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def parts_known_whole_unknown(parts: DataFrame, doc: str, part: str, pool: DataFrame, wholes: DataFrame) -> DataFrame:
    """(doc, whole): every part is in the pool (part), but the sorted combination is not among the known ones (whole).
    A known part with a wrong hash is told apart by `dependency_check`."""
    x = parts.join(pool.select(part, F.lit(True).alias("_k")).distinct(), part, "left")
    whole = x.groupBy(doc).agg(F.bool_and(F.col("_k").isNotNull()).alias("_all"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(part).cast("string"))), "|"), 256).alias("whole"))
    return whole.filter("_all").join(wholes.select("whole"), "whole", "left_anti").select(doc, "whole")


def partial_replacement(parts: DataFrame, expected: DataFrame, doc: str, part: str, hash_col: str) -> DataFrame:
    """(doc, matches, n): documents where some of the expected static parts (part, hash) match and some don't."""
    e = expected.select(part, F.col(hash_col).alias("_h"))
    out = parts.join(e, part).groupBy(doc).agg(F.count_if(F.col(hash_col) == F.col("_h")).alias("matches"), F.count("*").alias("n"))
    return out.filter("matches > 0 and matches < n")


def nearest_template(df: DataFrame, doc: str, x: str, templates: DataFrame, *, tol: float) -> DataFrame:
    """(doc, template, distance): the template (template, at) nearest to x within the tolerance; ties go to the smaller name.

    Values are met in buckets as wide as the tolerance, a template standing in its own and both neighbours;
    with a tolerance of 0 they are met by value.
    """
    t = templates.select(F.col("at").cast("double").alias("_t"), "template")
    d = df.select(F.col(doc), F.col(x).cast("double").alias("_x"))
    b = lambda c: F.floor(F.col(c) / tol) if tol > 0 else F.col(c)
    near = d.withColumn("_b", b("_x")).join(t.withColumn("_b", F.explode(F.array(*([b("_t") - 1, b("_t"), b("_t") + 1] if tol > 0 else [b("_t")])))), "_b")
    dist = F.abs(F.col("_x") - F.col("_t"))
    best = near.filter(dist <= tol).groupBy(doc).agg(F.min(F.struct(dist.alias("distance"), "template")).alias("_m"))
    return best.select(doc, "_m.template", "_m.distance")


def template_check(df: DataFrame, doc: str, x: str, templates: DataFrame, *, tol: float, ranges: Sequence[str] = (), modes: Sequence[str] = ()) -> DataFrame:
    """(doc, template, breaks): the nearest template and the metrics that it doesn't allow.

    A template has the columns m_lo and m_hi for a metric m of `ranges` and an array m_modes for one of `modes`; an open end, an empty
    array and a null metric pass. Documents without a template near enough have a null one and break nothing. One row per document.
    """
    best = nearest_template(df, doc, x, templates, tol=tol).select(doc, "template")
    rules = templates.select("template", *[F.col(f"{m}_{e}").alias(f"_{m}_{e}") for m in ranges for e in ("lo", "hi")], *[F.col(f"{m}_modes").alias(f"_{m}_modes") for m in modes])
    at = df.select(doc, *dict.fromkeys([*ranges, *modes])).join(best, doc, "left").join(rules, "template", "left")
    out = [F.when((F.col(m) < F.col(f"_{m}_lo")) | (F.col(m) > F.col(f"_{m}_hi")), m) for m in ranges]
    out += [F.when((F.size(f"_{m}_modes") > 0) & ~F.array_contains(f"_{m}_modes", F.col(m)), m) for m in modes]
    return at.select(doc, "template", F.array_compact(F.array(*out)).alias("breaks"))


def overlap_pairs(boxes: DataFrame, doc: str, item: Sequence[str], x0: str, x1: str, y0: str, y1: str, *, crowd: int = 64) -> DataFrame:
    """Pairs of a document's boxes that overlap, the smaller item first.

    A document with more than `crowd` boxes is cut into square cells, so many that a cell would hold about one box if
    boxes were dealt evenly, but none smaller than the document's mean box; a box stands in every cell that it touches,
    and a pair is told in the cell that holds the lower corner of what the two share. So the pairs made follow the pairs
    told, and one document is many groups. Boxes without an extent, or with a side that isn't known, overlap nothing.
    """
    sides = (x0, x1, y0, y1)
    b = boxes.select(doc, F.struct(*item).alias("i"), *[F.col(c).cast("double").alias(c_) for c, c_ in zip(sides, ("x0", "x1", "y0", "y1"), strict=True)]).filter("x0 < x1 and y0 < y1")
    stats = b.groupBy(doc).agg(F.count("*").alias("n"), F.min("x0").alias("left"), F.min("y0").alias("low"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("reach"), F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("mean"))
    size = F.when(F.col("n") > crowd, F.greatest(F.col("reach") / F.ceil(F.sqrt("n")), F.col("mean"))).otherwise(F.col("reach") * 2)
    placed = b.join(stats.select(F.col(doc), "left", "low", size.alias("size")), doc)
    cell = lambda c, start: F.floor((F.col(c) - F.col(start)) / F.col("size"))
    placed = placed.withColumn("cx", F.explode(F.sequence(cell("x0", "left"), cell("x1", "left")))).withColumn("cy", F.explode(F.sequence(cell("y0", "low"), cell("y1", "low"))))
    a = placed.select(doc, "cx", "cy", F.col("i").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1", "left", "low", "size")])
    o = placed.select(doc, "cx", "cy", F.col("i").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
    met = a.join(o, [doc, "cx", "cy"]).filter("a < b and ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1")
    corner = lambda p, q, start: F.floor((F.greatest(p, q) - F.col(start)) / F.col("asize"))
    return met.filter((F.col("cx") == corner("ax0", "bx0", "aleft")) & (F.col("cy") == corner("ay0", "by0", "alow"))).select(doc, "a", "b")


def right_overflow(boxes: DataFrame, doc: str, item: Sequence[str], x1: str, second: str, pages: DataFrame, right: str, *, tol: float = 0.0) -> DataFrame:
    """(doc, item): boxes that end beyond the right edge of their page (doc, right) by more than the tolerance, by both measures of
    their end; a box that lacks one isn't told."""
    edge = F.col(right) + F.lit(tol)
    return boxes.join(pages.select(doc, right), doc).filter((F.col(x1) > edge) & (F.col(second) > edge)).select(doc, *item)


def dedup_two_keys(df: DataFrame, file_key: str, identity_key: str, order: Sequence[str], id_col: str) -> DataFrame:
    """`duplicate_of`: the first earlier row with the same file, else with the same identity. Two joins with the first of each key, never an OR-join."""
    out = df
    for key, name in ((file_key, "_a"), (identity_key, "_b")):
        first = df.filter(known(key)).groupBy(F.col(key).alias("_key")).agg(F.min_by(id_col, F.struct(*order)).alias(name))
        # what isn't known is equal to nothing; rows without it are dealt out by their own id
        salted = F.when(known(key), F.lit(None)).otherwise(F.xxhash64(id_col))
        out = out.withColumn("_salt", salted).join(first.withColumn("_none", F.lit(None).cast("long")), (F.col(key) == F.col("_key")) & F.col("_salt").eqNullSafe(F.col("_none")), "left").drop("_salt", "_none", "_key")
    earlier = lambda c: F.when(F.col(c) != F.col(id_col), F.col(c))
    return out.withColumn("duplicate_of", F.coalesce(earlier("_a"), earlier("_b"))).drop("_a", "_b")


def users_today(users: DataFrame, checks: DataFrame, user: str, ts: str, name: str, *, day: str, k: int) -> DataFrame:
    """The k users active that day with most checks, with their names."""
    n = checks.filter(F.to_date(ts) == F.lit(day).cast("date")).groupBy(user).agg(F.count("*").alias("checks"), F.max(ts).alias("last"))
    return n.join(users.select(user, name), user, "left").orderBy(F.desc("last"), user).limit(k)


def all_participants(a: DataFrame, b: DataFrame, user: str) -> DataFrame:
    return a.select(user).union(b.select(user)).distinct()


def closure_diff(items: DataFrame, doc: str, item: str, side: str, *, left: str, right: str) -> DataFrame:
    """(doc, item, only): items on one side of a document only."""
    by = items.groupBy(doc, item).agg(F.bool_or(F.col(side) == left).alias("_l"), F.bool_or(F.col(side) == right).alias("_r"))
    return by.filter("_l != _r").select(doc, item, F.when(F.col("_l"), left).otherwise(right).alias("only"))


def recent_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def multi_key_rank(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    return df.orderBy(*keys)


def retain_last_n(df: DataFrame, order: Sequence[Column], n: int, *, partition: Sequence[str]) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def retain_ttl_cap(df: DataFrame, ts: str, *, now: str, days: int, cap: int, partition: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows no older than so many days, the newest `cap` of each key."""
    return retain_last_n(df.filter(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))), order, cap, partition=partition)


def collapse_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(cols))
