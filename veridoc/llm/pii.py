r"""Personal data: patterns for four kinds, and bootstrapped contextual extraction of what they miss.

Base. E-mail addresses, IP addresses, card numbers and telephone numbers are found by regular expression,
leftmost first and without overlap within a kind; a match that fails its check is dropped. Places come from
the pieces between the matches. The expressions are possessive, and begin where a run of their characters
begins or the last match ended (`\G`), which finds the same matches in time linear in the text.

Bootstrapping. Every identifier-like word (four digits or an at sign, 6 characters), groups of digits after
it included, is an instance, and the word before it with its own shape is the lexical pattern it stands in.
Base matches are the seeds. In every round, each pattern's confidence for a kind is the score of its
instances over their number, with MIN_SUPPORT at least; each instance's score is the noisy-or of its
confident patterns. Instances that no base match touches and whose score reaches the threshold are told as
spans of that kind. A number like a card's with a wrong check digit, where card numbers usually stand, is
such an instance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, whole

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A run of characters that are not white space, with a digit or an at sign in it, and the groups of digits after it, each after one space.
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?<=[0-9)]) \(?+[0-9][0-9().-]*+[,;:!?]?+(?!\S))*+"
ROUNDS, MIN_SUPPORT, CONFIDENT, ACCEPTED = 3, 3, 0.8, 0.9
SHORTEST = 6
#: Matches of a text whose places are summed up together; the sums of these are summed up in turn.
BLOCK = 256
#: Characters of a text in which base matches and instances are met.
SPAN = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    # a part of more than three digits without its leading zeros is over 255
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0"))).otherwise(F.lit("999")).try_cast("int"), F.lit(0)) <= 255),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<p, m>>: each match m with the piece p between it and the one before; after the last, p alone."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))


def _placed(pairs: Column, left: Callable[[Column, Column], Column]) -> Column:
    """array<struct<s, e, m, l>>: the matches with their places in code points, and `left` of the piece and the match before.

    Lists grow by copying, so a list of all matches would take time by the square of their number: places are
    taken in blocks, and the blocks moved to where they begin.
    """
    kind = "array<struct<s: int, e: int, m: string, l: string>>"
    none, blocks = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), left(x["p"], acc["last"]).alias("l")))
        return F.struct(end.alias("at"), F.coalesce(x["m"], F.lit("")).alias("last"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def block(i: Column) -> Column:
        last = F.coalesce(F.get(pairs, i - 1)["m"], F.lit(""))
        return F.aggregate(F.slice(pairs, i + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), last.alias("last"), none.alias("out")), add)

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e"), y["m"].alias("m"), y["l"].alias("l")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    begins = F.filter(F.sequence(F.lit(0), F.size(pairs), F.lit(BLOCK)), lambda i: i < F.size(pairs))
    return F.aggregate(F.transform(begins, block), F.struct(F.lit(0).alias("at"), blocks.alias("out")), join, lambda acc: F.flatten(acc["out"]))


def _last_word(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"(?<!\S)(\S++)\s*+$", 1))


def _context(piece: Column, before: Column) -> Column:
    """The last word before a match; directly after another match, that one's last word."""
    own = _last_word(piece)
    return F.when(own != "", own).otherwise(_last_word(before))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _k1, _k2, base, words): the base spans of each row and its identifier-like words. One pass over the texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("_text"))
    rows = rows.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_k1"), F.xxhash64("_text").alias("_k2"), F.col("_text").rlike("[0-9@]").alias("_some"))
    text = F.col("_text")
    empty = F.expr("cast(array() as array<struct<p: string, m: string>>)")
    # the pairs are columns of their own, so that no lambda computes them again
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", F.when(F.col("_some") & text.contains(NEEDS[kind]), _matches(text, PATTERNS[kind])).otherwise(empty))
    rows = rows.withColumn("_word", F.when(F.col("_some"), _matches(text, WORD)).otherwise(empty)).drop("_text", "_some")

    base = []
    for n, kind in enumerate(KINDS):
        base.append(F.transform(F.filter(_placed(F.col(f"_{kind}"), lambda p, m: F.lit("")), _checked(kind)), _told(n, kind)))
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))
    return rows.select("doc_id", "_k1", "_k2", "base", F.filter(F.transform(_placed(F.col("_word"), _context), _core), _identifier).alias("words"))


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda x: CHECKS[kind](x["m"])


def _told(n: int, kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def _core(x: Column) -> Column:
    """An instance without the punctuation around it, its place, the word before, and its shape."""
    cut_left = F.regexp_replace(x["m"], r"^[^A-Za-z0-9+]+", "")
    start = x["s"] + F.length(x["m"]) - F.length(cut_left)
    value = F.regexp_replace(cut_left, r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    return F.struct(start.alias("s"), (start + F.length(value)).alias("e"), value.alias("value"), x["l"].alias("left"), shape.alias("shape"))


def _identifier(x: Column) -> Column:
    return (F.length(x["value"]) >= SHORTEST) & ((F.length(_digits(x["value"])) >= 4) | x["value"].contains("@"))


def _seeded(rows: DataFrame) -> DataFrame:
    """(_k1, _k2, s, e, value, left, shape, seed): each place of an instance once, with the kind of the first base match that touches it, or null.

    Both are met by the stretch of SPAN characters that they stand in, so a text with many of either is dealt out.
    """
    key = ["_k1", "_k2"]
    stretches = F.explode(F.sequence(F.floor(F.col("s") / SPAN), F.floor((F.col("e") - 1) / SPAN))).alias("_at")
    words = rows.select(*key, F.explode("words").alias("w")).select(*key, "w.*")
    base = rows.select(*key, F.explode("base").alias("b")).select(*key, "b.s", "b.e", "b.n")
    base = base.select(*key, stretches, F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("n").alias("_n"))
    touched = words.select("*", stretches).join(base, [*key, "_at"]).filter((F.col("_s") < F.col("e")) & (F.col("_e") > F.col("s")))
    first = touched.groupBy(*key, "s").agg(F.min(F.struct("_s", "_n")).alias("_b")).select(*key, "s", F.col("_b._n").alias("seed"))
    return words.distinct().join(first, [*key, "s"], "left")


def bootstrap(places: DataFrame, *, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, confident: float = CONFIDENT, accepted: float = ACCEPTED) -> DataFrame:
    """(value, n, score): instances with the kind they are taken for, by its place in KINDS.

    `places(value, left, shape, seed)` has a row for each place of an instance; seed is the kind of the base
    match there, or null. Seeds keep the score 1; a place at the start of a text, without a word before it, is in no pattern.
    """
    edges = cut(places.groupBy("left", "shape", "value").agg(F.min("seed").alias("seed")))
    totals = edges.filter("left != ''").groupBy("left", "shape").agg(F.count("*").alias("total"))
    seeds = edges.filter("seed is not null").groupBy("value").agg(F.min("seed").alias("n")).withColumn("score", F.lit(1.0))
    known = seeds = cut(seeds)
    edges = edges.select("left", "shape", "value")
    for _ in range(rounds):
        patterns = edges.join(known, "value").groupBy("left", "shape", "n").agg(F.sum("score").alias("hits"))
        patterns = patterns.join(totals, ["left", "shape"]).withColumn("confidence", F.col("hits") / F.col("total")).filter((F.col("hits") >= min_support) & (F.col("confidence") >= confident))
        miss = F.log(1 - F.least("confidence", F.lit(0.999)))
        scored = edges.join(patterns.select("left", "shape", "n", "confidence"), ["left", "shape"]).groupBy("value", "n").agg((1 - F.exp(F.sum(miss))).alias("score")).filter(F.col("score") >= accepted)
        best = F.max(F.struct("score", (-F.col("n")).alias("first")))
        known = cut(scored.union(seeds.select("value", "n", "score")).groupBy("value").agg(best.alias("b")).select("value", (-F.col("b.first")).alias("n"), "b.score"))
    return known


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): a row for each row of `docs` with its base spans and those of the method.

    Both are arrays of (s, n, e, kind), places in code points, end exclusive, sorted by start and kind. Null
    or empty texts have none; rows that repeat, null ids and clashing column names change nothing.
    """
    rows = cut(scan(docs, id_col=id_col, text_col=text_col))
    places = cut(_seeded(rows))
    known = bootstrap(places.select("value", "left", "shape", "seed"))
    kinds = F.array(*map(F.lit, KINDS))
    new = places.filter("seed is null").join(known, "value")
    new = new.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(F.struct("s", "n", "e", F.get(kinds, F.col("n")).alias("kind")))).alias("found"))
    none = F.expr("cast(array() as array<struct<s: int, n: int, e: int, kind: string>>)")
    return rows.join(new, ["_k1", "_k2"], "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))
