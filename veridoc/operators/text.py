"""Fields, amounts, dates, ids and hashes out of text, by built-in expressions only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that money and labels are written with besides the ASCII kinds.
SPACES = "\u00a0\u202f\u2009\u2007"
#: Hyphens that `semantic_hash` folds after compatible characters.
FOLDED = ("‐‑‒–—−", "------")


def content_hashes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For each column its sha256 and the first 16 digits of it."""
    for c in cols:
        df = df.withColumn(f"{c}_sha256", F.sha2(F.col(c).cast("binary"), 256)).withColumn(f"{c}_sha16", F.substring(f"{c}_sha256", 1, 16))
    return df


def skeleton_hash(df: DataFrame, text: str, masks: Sequence[tuple[str, str]], *, out: str = "skeleton") -> DataFrame:
    """The hash of a text with its variable parts masked, which names its template."""
    t = F.col(text)
    for pattern, to in masks:
        t = F.regexp_replace(t, pattern, to)
    return df.withColumn(out, F.sha2(t, 256))


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes, characters that become several or none) by Unicode's compatibility normalisation of single characters."""
    one, to, many = [], [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        if (n := unicodedata.normalize("NFKC", c)) != c:
            if len(n) == 1:
                one.append(c)
                to.append(n)
            else:
                many[c] = n
    return "".join(one), "".join(to), many


def _class(chars: Iterable[str]) -> str:
    """A character class of a regular expression: the characters as ranges."""
    codes = sorted(map(ord, chars))
    first = [n for k, n in enumerate(codes) if not k or codes[k - 1] != n - 1]
    last = [n for k, n in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != n + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True)) + "]"


def _beyond(chars: Iterable[str]) -> str:
    """The class of those of the characters that Latin-1 has, and of all that it hasn't."""
    return _class(c for c in chars if c < "\u0100")[:-1] + "\\x{100}-\\x{10ffff}]"


def compatible(text: Column) -> Column:
    """Each character as what Unicode's compatibility normalisation makes of it; letters and the marks after them aren't put together.

    Characters that become one other are translated; texts with one that becomes several go character by character.
    """
    one, to, many = _compatible()
    t = F.translate(text, one, to)
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    longer = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    # most texts have none of these and no character beyond Latin-1
    return F.when(text.rlike(_beyond((*one, *many))), F.when(t.rlike(_class(many)), longer).otherwise(t)).otherwise(text)


@cache
def _joining() -> str:
    """The characters that normalisation may join with, or move among, the characters before them: marks, letters that end a composed one, and what becomes any of these."""
    every = [chr(n) for n in (*range(0x80, 0xD800), *range(0xE000, 0x110000))]
    ends = {c for c in every if unicodedata.combining(c)}
    for c in every:
        canonical = unicodedata.normalize("NFD", c)
        if len(canonical) > 1 and unicodedata.normalize("NFC", c) == c:
            ends.update(canonical[1:])
    return "".join(c for c in every if not ends.isdisjoint(unicodedata.normalize("NFKC", c)))


@cache
def _normalize() -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, T.StringType())


def normalized(text: Column) -> Column:
    """Unicode's compatibility normalisation (NFKC) of whole texts; null stays null.

    Character by character (`compatible`) but for texts with characters that join those before them, as in
    letters that are written with their marks behind. Only those are sent to Python.
    """
    # looked up one by one: a regular expression would try hundreds of ranges at each character
    joins = text.rlike(_beyond(_joining())) & (F.length(F.translate(text, _joining(), "")) < F.length(text))
    return F.when(joins, _normalize()(F.when(joins, text))).otherwise(compatible(text))


def semantic_hash(df: DataFrame, text: str, *, out: str = "semantic") -> DataFrame:
    """The hash of a text with compatible and composed characters, spaces, hyphens and line ends folded, lower case; ids split over lines are joined again."""
    t = F.translate(normalized(F.col(text)), *FOLDED)  # spaces of all kinds are plain ones by now
    t = F.regexp_replace(t, r"-[ \t]*\r?\n[ \t]*", "")
    return df.withColumn(out, F.sha2(F.trim(F.lower(F.regexp_replace(t, r"[ \t\r\n]+", " "))), 256))


def critical_signature(df: DataFrame, cols: Sequence[str], *, out: str = "signature") -> DataFrame:
    """sha256 of the columns as a JSON object with sorted keys; null counts as empty text."""
    pairs = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(cols)]
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*pairs)), 256))


def identity_hash(df: DataFrame, cols: Sequence[str], strong: Column, *, out: str = "identity") -> DataFrame:
    """sha256 of the columns joined by |, or "" where the identity is not strong."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return df.withColumn(out, F.when(strong, F.sha2(joined, 256)).otherwise(""))


def txn_signature(df: DataFrame, amount: str, date: str, receiver: str, *, out: str = "txn") -> DataFrame:
    parts = [F.col(amount).cast("decimal(18,2)").cast("string"), F.date_format(date, "yyyy-MM-dd"), F.lower(F.trim(receiver))]
    return df.withColumn(out, F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def requisite_keys(df: DataFrame, *, phone: str | None = None, card: str | None = None, account: str | None = None, name: str | None = None, out: str = "keys") -> DataFrame:
    """The keys `phone:`, `card:`, `acct:` of a row and, for an account with a name, `acct4:last four|name`."""
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[^0-9]", "")
    keys = []
    if phone:
        keys.append(F.when(F.length(digits(phone)) >= 10, F.concat(F.lit("phone:"), F.right(digits(phone), F.lit(10)))))
    if card:
        keys.append(F.when(F.length(digits(card)) >= 12, F.concat(F.lit("card:"), digits(card))))
    if account:
        keys.append(F.when(F.length(digits(account)) >= 16, F.concat(F.lit("acct:"), digits(account))))
        if name:
            keys.append(F.when((F.length(digits(account)) >= 4) & (F.coalesce(F.trim(name), F.lit("")) != ""), F.concat(F.lit("acct4:"), F.right(digits(account), F.lit(4)), F.lit("|"), F.lower(F.trim(name)))))
    return df.withColumn(out, F.array_compact(F.array(*keys)))


def extract_opid(df: DataFrame, text: str, *, pattern: str, suffix: str, length: int, out: str = "opid") -> DataFrame:
    """Of the matches the one with the wanted suffix, then of the length nearest to the canonical one, then the longest; ties by text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    ranked = F.transform(found, lambda m: F.struct((~F.endswith(m, F.lit(suffix))).alias("a"), F.abs(F.length(m) - length).alias("b"), (-F.length(m)).alias("c"), m.alias("m")))
    return df.withColumn(out, F.array_min(ranked)["m"])


def extract_any_opid(df: DataFrame, text: str, patterns: Sequence[str], *, out: str = "any_opid") -> DataFrame:
    """The match of the first pattern that matches."""
    return df.withColumn(out, F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns]))


def receipt_key(df: DataFrame, opid: str, file_hash: str, *, out: str = "receipt_key") -> DataFrame:
    return df.withColumn(out, F.when(F.coalesce(F.col(opid), F.lit("")) != "", F.concat(F.lit("opid:"), opid)).otherwise(F.concat(F.lit("file:"), file_hash)))


def label_field_extract(df: DataFrame, text: str, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each field the value of its longest label that is there: after a colon, a space, or on the next line that isn't empty."""
    for field, names in labels.items():
        tries = []
        for label in sorted(names, key=len, reverse=True):
            quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)
            tries.append(F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^[ \t]*{quoted}[ \t]*:?[ \t]*\n*[ \t]*([^\n]+)", 1)), F.lit("")))
        df = df.withColumn(field, F.coalesce(*tries))
    return df


#: Money at the end of a text: a sign, a whole part with groups parted by spaces, full stops or commas, and one or two decimals.
AMOUNT = r"(?:^|[^0-9.,-])(-?)([0-9]{1,3}(?:[.,][0-9]{3})+|[0-9][0-9 ]*)(?:[.,]([0-9]{1,2}))?$"
#: What money isn't written with: marks of phones, masks, addresses and numbers of documents, and dates.
NO_AMOUNT = r"[+()*@№]|[0-9]{2}\.[0-9]{2}\.[0-9]{4}"


def parse_amount(df: DataFrame, col: str, *, out: str = "amount") -> DataFrame:
    """The money at the end of a text, before a currency sign or a word of up to three letters; null where there is none.

    Of two kinds of separators the last is the decimal one; three digits after a separator are a group.
    Texts that hold a date, a mask, or a sign of a phone number or an address are no money.
    """
    t = F.btrim(F.regexp_replace(F.btrim(F.translate(F.col(col), SPACES, " " * len(SPACES))), r" *(?:[₽$€£]|[A-Za-zА-Яа-я]{1,3}\.?)$", ""))
    sign, whole, part = (F.regexp_extract(t, AMOUNT, i) for i in (1, 2, 3))
    written = F.concat(sign, F.regexp_replace(whole, "[ .,]", ""), F.lit("."), F.rpad(part, 2, "0"))
    return df.withColumn(out, F.when(~F.col(col).rlike(NO_AMOUNT) & (whole != ""), written.try_cast("decimal(18,2)")))


def format_amount(df: DataFrame, col: str, *, out: str = "formatted") -> DataFrame:
    """Thousands parted by spaces, a comma before the two decimals."""
    return df.withColumn(out, F.translate(F.format_number(F.col(col).cast("decimal(18,2)"), 2), ",.", " ,"))


#: A date and its time in lower-cased text.
DATE_TIME = r"\b([0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:[ ,t]+([0-9]{2}:[0-9]{2})(:[0-9]{2})?)?"


def parse_datetimes(df: DataFrame, text: str, *, labels: Sequence[str] = (), months: Mapping[str, int] = {}, out: str = "printed_at") -> DataFrame:
    """The first date with its time, if there is one: after the first of the labels that one follows, else anywhere in the text.

    A date is dd.mm.yyyy or, where none stands there, a day, a word that begins as one of `months` (lower case) and a year.
    Labels are found in any case. Null where there is no date or it is none in the calendar.
    """
    t = F.lower(F.translate(F.col(text), SPACES, " " * len(SPACES)))
    clock = lambda hm, sec: F.concat(F.lit(" "), F.when(hm == "", "00:00").otherwise(hm), F.when(sec == "", ":00").otherwise(sec))
    at = lambda date, hm, sec: F.try_to_timestamp(F.concat(date, clock(hm, sec)), F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz")

    def first(s):
        date, hm, sec = (F.regexp_extract(s, DATE_TIME, i) for i in (1, 2, 3))
        worded = F.lit(None).cast("timestamp_ntz")
        if months:
            pattern = r"\b([0-9]{1,2}) +(" + "|".join(months) + r")\p{L}*\.? +([0-9]{4})(?:[ ,]+([0-9]{2}:[0-9]{2})(:[0-9]{2})?)?"
            day, word, year, word_hm, word_sec = (F.regexp_extract(s, pattern, i) for i in range(1, 6))
            number = F.create_map(*[F.lit(x) for m, n in months.items() for x in (m, f"{n:02d}")])[word]
            worded = at(F.concat_ws(".", F.lpad(day, 2, "0"), number, year), word_hm, word_sec)
        return F.when(date != "", at(date, hm, sec)).otherwise(worded)

    regions = [F.regexp_extract(t, "(?s)" + re.escape(x.lower()) + "(.*)", 1) for x in labels]
    return df.withColumn(out, F.coalesce(*[first(r) for r in regions], first(t)))


def parse_pdf_date(df: DataFrame, col: str, *, out: str = "instant") -> DataFrame:
    """D:YYYYMMDDhhmmss with an offset such as +03'00' as an instant; without one it is UTC."""
    t = F.regexp_replace(F.regexp_replace(F.col(col), "^D:", ""), "'", "")
    stamp, zone = F.regexp_extract(t, "^([0-9]{14})", 1), F.regexp_extract(t, "^[0-9]{14}([+-][0-9]{4})", 1)
    return df.withColumn(out, F.try_to_timestamp(F.when(stamp != "", F.concat(stamp, F.when(zone == "", "+0000").otherwise(zone))), F.lit("yyyyMMddHHmmssxx")))


def id_decode(df: DataFrame, id_col: str, layout: Sequence[tuple[str, int, int]], *, out: str = "parts") -> DataFrame:
    """A positional id as a struct of its slots (name, from, length)."""
    return df.withColumn(out, F.struct(*[F.substring(id_col, a, n).alias(name) for name, a, n in layout]))


def id_structure_check(df: DataFrame, doc: str, id_col: str, issuer: str, grammar: DataFrame) -> DataFrame:
    """(doc, code): rules of the issuer's grammar (issuer, slot, at, len, regex, code) that an id breaks; slot "length" holds for the whole."""
    x = df.select(doc, id_col, issuer).join(grammar, issuer)
    part = F.expr(f"substring({id_col}, at, len)")
    bad = F.when(F.col("slot") == "length", F.length(id_col) != F.col("len")).otherwise(~F.regexp_like(part, F.col("regex")))
    return x.filter(bad).select(doc, "code")


def id_time_check(df: DataFrame, day: str, hour: str, minute: str, ts: str, *, hours: int = 1, minutes: int = 5, shift_hours: int = 3) -> DataFrame:
    """Whether the day, hour and minute inside an id, shifted to local time, agree with the printed time; hours and minutes are circular."""
    local = F.col(ts)
    apart = lambda a, b, n: F.least(F.abs(a - b), n - F.abs(a - b))
    h = F.pmod(F.col(hour) + shift_hours, F.lit(24))
    carry = F.floor((F.col(hour) + shift_hours) / 24)
    return (
        df.withColumn("day_ok", F.abs(F.col(day) + carry - F.dayofyear(local)) <= 1)
        .withColumn("hour_ok", apart(h, F.hour(local), 24) <= hours)
        .withColumn("minute_ok", apart(F.col(minute), F.minute(local), 60) <= minutes)
    )


def letter_density(df: DataFrame, id_col: str, start: int, length: int, most: int) -> DataFrame:
    letters = F.length(F.regexp_replace(F.substring(id_col, start, length), "[^A-Za-z]", ""))
    return df.withColumn("letters", letters.cast("long")).withColumn("dense", F.col("letters") > most)


def amount_arithmetic(df: DataFrame, amount: str, fee: str, total: str, *, eps: float = 0.0) -> DataFrame:
    """Whether amount and fee make the total; null where one is missing, the fee isn't below the amount, or the total is below it."""
    a, f, t = (F.col(c).cast("decimal(18,2)") for c in (amount, fee, total))
    applies = a.isNotNull() & f.isNotNull() & t.isNotNull() & (f < a) & (t >= a)
    return df.withColumn("adds_up", F.when(applies, F.abs(a + f - t) <= F.lit(eps).cast("decimal(18,2)")))


def amount_triples(df: DataFrame, amounts: str, *, eps: float = 0.05, out: str = "first_mismatch") -> DataFrame:
    """Where, from 0, the first three neighbours of an array of amounts stand that should be amount, fee and total and don't add up; null for none.

    Threes with a null, with a fee that isn't below the amount or with a total below it are passed over.
    """
    at = lambda i: F.get(F.col(amounts), i).cast("decimal(18,2)")
    off = lambda i: (at(i + 1) < at(i)) & (at(i + 2) >= at(i)) & (F.abs(at(i) + at(i + 1) - at(i + 2)) > F.lit(eps).cast("decimal(18,2)"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(amounts) - 3, F.lit(0)))
    return df.withColumn(out, F.get(F.filter(starts, off), F.lit(0)).cast("long"))


def amount_typography(df: DataFrame, text: str, *, currency: str = "RUR|RUB|USD|EUR|[₽$€£]") -> DataFrame:
    """How a text writes its amounts: with and without grouping (`mixed_grouping` where both occur), how many currency marks are padded
    with two no-break spaces or more, and whether some marks have one behind them and others don't (`uneven_trail`)."""
    grouped = F.regexp_count(text, F.lit(r"\b[0-9]{1,3}(?:[ \u00a0][0-9]{3})+[.,][0-9]{2}\b"))
    plain = F.regexp_count(text, F.lit(r"(?<![0-9 \u00a0])[0-9]{4,}[.,][0-9]{2}\b"))
    mark = rf"[0-9][ \u00a0]?(?:{currency})"
    marks, trailed = F.regexp_count(text, F.lit(mark)), F.regexp_count(text, F.lit(mark + r"\u00a0"))
    return (
        df.withColumn("grouped", grouped.cast("long")).withColumn("ungrouped", plain.cast("long")).withColumn("mixed_grouping", (grouped > 0) & (plain > 0))
        .withColumn("padded", F.regexp_count(text, F.lit(mark + r"\u00a0{2,}")).cast("long")).withColumn("uneven_trail", (trailed > 0) & (trailed < marks))
    )


def _ladders(alphabet: str) -> str:
    """A pattern of two or more letters that follow each other in the alphabet, as many as there are."""
    rest = lambda s: f"(?:{s[0]}{rest(s[1:])})?" if s else ""
    return "|".join(alphabet[i : i + 2] + rest(alphabet[i + 2 :]) for i in range(len(alphabet) - 1))


LADDERS = _ladders("".join(map(chr, range(ord("a"), ord("z") + 1)))) + "|" + _ladders("".join(map(chr, range(ord("а"), ord("я") + 1))))


def text_artifact_scores(df: DataFrame, col: str) -> DataFrame:
    """Marks of made-up text: the longest run of consonants of one script and of letters in the order of the alphabet (0 for none),
    digits that are one more than the digit before them (whatever stands between), whether the last four digits are ABAB,
    control characters, padding, and runs of three like characters."""
    low = F.lower(col)
    longest = lambda p: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(0)), F.length)), F.lit(0)).cast("long")
    digits = F.regexp_replace(col, "[^0-9]", "")
    return (
        df.withColumn("consonant_run", longest("[bcdfghjklmnpqrstvwxz]+|[бвгджзйклмнпрстфхцчшщъь]+"))
        .withColumn("alphabet_run", longest(LADDERS))
        .withColumn("ascending_digits", F.regexp_count(digits, F.lit("(?=01|12|23|34|45|56|67|78|89)")).cast("long"))
        .withColumn("abab_tail", _abab(F.regexp_extract(col, "([0-9]{4})[^0-9]*$", 1)))
        .withColumn("control_chars", F.length(F.regexp_replace(col, r"[^\x01-\x08\x0B\x0C\x0E-\x1F]", "")).cast("long"))
        .withColumn("padding", (F.length(col) - F.length(F.btrim(F.col(col)))).cast("long"))
        .withColumn("triples", F.regexp_count(col, F.lit("aaa|eee|###|!!!|\\*\\*\\*|&&&")).cast("long"))
    )


def _abab(four: Column) -> Column:
    """Whether four characters are two unlike ones and the same again."""
    one = lambda i: F.substring(four, i, 1)
    return (F.length(four) == 4) & (one(1) == one(3)) & (one(2) == one(4)) & (one(1) != one(2))


CARD_MASK = r"\b([0-9]{4})[0-9 ]{0,3}[*xX]{4,8} ?([0-9]{4})\b"


def card_masks(df: DataFrame, text: str, prefixes: Sequence[str]) -> DataFrame:
    """Masked card numbers: how many, the first two's heads and tails (null where there is none), whether all have a known issuer
    prefix (null without cards), and whether a tail is ABAB."""
    heads, tails = (F.regexp_extract_all(text, F.lit(CARD_MASK), F.lit(i)) for i in (1, 2))
    known = lambda h: F.arrays_overlap(F.array(F.substring(h, 1, 1), F.substring(h, 1, 2)), F.array(*map(F.lit, prefixes)))
    out = df.withColumn("cards", F.size(heads).cast("long"))
    for i, name in enumerate(("card", "second")):
        out = out.withColumn(f"{name}_head", F.get(heads, F.lit(i))).withColumn(f"{name}_tail", F.get(tails, F.lit(i)))
    return out.withColumn("prefix_ok", F.when(F.size(heads) > 0, F.forall(heads, known))).withColumn("abab_tail", F.exists(tails, _abab))


def distinct_mentions(df: DataFrame, text: str, pattern: str, *, out: str = "mentions") -> DataFrame:
    return df.withColumn(out, F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).cast("long"))


def regime_check(df: DataFrame, doc: str, token: str, dates: str | Sequence[str], regimes: DataFrame) -> DataFrame:
    """(doc, token): tokens outside their regime (token, valid_from, valid_to) on one of the dates; open ends are null, a token may have
    several regimes, unknown tokens and null dates pass."""
    r = regimes.withColumnRenamed("token", "_t")
    x = df.join(r, df[token] == r["_t"])
    inside = lambda d: F.coalesce(F.col(d) >= F.col("valid_from"), F.lit(True)) & F.coalesce(F.col(d) < F.col("valid_to"), F.lit(True))
    held = [F.bool_or(inside(d)).alias(f"_ok{i}") for i, d in enumerate([dates] if isinstance(dates, str) else dates)]
    return x.groupBy(doc, token).agg(*held).filter(" or ".join(f"not _ok{i}" for i in range(len(held)))).select(doc, token)


def metadata_drift(df: DataFrame, created: str, modified: str, operation: str, *, edit_s: int = 60, late_s: int = 300) -> DataFrame:
    """Flags: modified long after creation, operation later than creation, all three clocks within a second."""
    s = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    spread = F.greatest(s(created), s(modified), s(operation)) - F.least(s(created), s(modified), s(operation))
    return df.withColumn("edited", F.abs(s(modified) - s(created)) > edit_s).withColumn("operation_late", s(operation) - s(created) > late_s).withColumn("clocks_collapse", spread <= 1)


def missing_text_layer(df: DataFrame, text: str, size: str, *, least: int = 30) -> DataFrame:
    return df.withColumn("missing_text", (F.length(F.btrim(F.coalesce(F.col(text), F.lit("")))) < least) & (F.coalesce(F.col(size), F.lit(0)) > 0))


def marker_profile(df: DataFrame, doc: str, content: str, markers: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(doc, code, n): markers (code, pattern, most) that a content has more often than it may. Binary content counts by byte."""
    text = F.decode(content, "ISO-8859-1") if dict(df.dtypes)[content] == "binary" else F.col(content)
    counts = F.array(*[F.struct(F.lit(code).alias("code"), F.regexp_count(text, F.lit(p)).alias("n"), F.lit(most).alias("_most")) for code, p, most in markers])
    return df.select(doc, F.explode(counts).alias("_m")).select(doc, "_m.*").filter("n > _most").select(doc, "code", F.col("n").cast("long").alias("n"))


def mixed_encoding(parts: DataFrame, doc: str, kind: str) -> DataFrame:
    return parts.groupBy(doc).agg(F.countDistinct(kind).alias("kinds")).withColumn("mixed", F.col("kinds") > 1)


def number_format(df: DataFrame, col: str, pattern: str, *, date_at: tuple[int, int, str] | None = None) -> DataFrame:
    """Whether a number has its form and, if it holds a date (from, length, format), a real one."""
    ok = F.col(col).rlike(pattern)
    if date_at:
        a, n, fmt = date_at
        ok = ok & F.try_to_timestamp(F.substring(col, a, n), F.lit(fmt)).isNotNull()
    return df.withColumn("well_formed", F.coalesce(ok, F.lit(False)))


def filename_grammar(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """The file name without a copy suffix, and whether it is an official one."""
    base = F.regexp_replace(F.col(name), r"( \([0-9]+\)| - copy|_copy[0-9]*)(?=\.[A-Za-z0-9]+$)", "")
    return df.withColumn("base_name", base).withColumn("official", F.col("base_name").rlike(pattern))


def char_entropy(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, entropy, chars): Shannon entropy of a text's characters in bits. Counted over distinct characters, in two aggregations."""
    chars = df.select(doc, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("_c")).filter("_c != ''")
    n = chars.groupBy(doc, "_c").agg(F.count("*").alias("_n"))
    out = n.groupBy(doc).agg(F.sum("_n").alias("chars"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"))
    return out.select(doc, (F.log2("chars") - F.col("_s") / F.col("chars")).alias("entropy"), "chars")


def domain_functions(df: DataFrame, address: str, banks: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """`host`, the registered domain, and with `banks` (domain, bank) the bank of the host, else of that domain.

    The registered domain is the longest of the `suffixes` (suffix) that the host ends with, and the label before it; a
    host that ends with none, and any host without the table, has its last two labels. A host that is a suffix stays.
    """
    host = F.lower(F.regexp_extract(address, r"(?:@|://)([A-Za-z0-9.-]+)", 1))
    labels = F.split("host", r"\.")
    last_two = F.greatest(F.size(labels) - 1, F.lit(1))
    out = df.withColumn("host", host)
    if suffixes is None:
        out = out.withColumn("registered", F.array_join(F.slice(labels, last_two, F.lit(2)), "."))
    else:
        # each host once, with a row for each of its ends; the longest that the table has begins first
        ends = out.select("host").filter("host != ''").distinct().withColumn("_at", F.explode(F.sequence(F.lit(1), F.size(labels))))
        ends = ends.withColumn("_end", F.array_join(F.slice(labels, F.col("_at"), F.size(labels)), "."))
        found = ends.join(suffixes.select(F.lower("suffix").alias("_end")).distinct(), "_end").groupBy("host").agg(F.min("_at").alias("_at"))
        start = F.when(F.col("_at").isNull(), last_two).otherwise(F.greatest(F.col("_at") - 1, F.lit(1)))
        out = out.join(found, "host", "left").withColumn("registered", F.array_join(F.slice(labels, start, F.size(labels)), ".")).select(*df.columns, "host", "registered")
    if banks is None:
        return out
    known = banks.groupBy(F.lower("domain").alias("_domain")).agg(F.min("bank").alias("_bank"))
    for c in ("host", "registered"):
        k = known.select(F.col("_domain").alias(f"_{c}"), F.col("_bank").alias(f"_{c}_bank"))
        out = out.join(k, out[c] == k[f"_{c}"], "left").drop(f"_{c}")
    return out.withColumn("bank", F.coalesce("_host_bank", "_registered_bank")).drop("_host_bank", "_registered_bank")


def sender_alignment(mails: DataFrame, domains: DataFrame) -> DataFrame:
    """`aligned`: one From, its domain's bank known, and a valid signature's domain or the passed envelope's maps to the same bank.

    `mails` has from_domain, from_count, dkim_domain, dkim_ok, env_domain, spf_ok; `domains` is (domain, bank).
    """
    d = domains.groupBy("domain").agg(F.min("bank").alias("bank"))
    for c in ("from", "dkim", "env"):
        mails = mails.join(d.select(F.col("domain").alias(f"{c}_domain"), F.col("bank").alias(f"{c}_bank")), f"{c}_domain", "left")
    same = lambda c, ok: F.coalesce(F.col(f"{c}_bank") == F.col("from_bank"), F.lit(False)) & F.coalesce(F.col(ok), F.lit(False))
    return mails.withColumn("aligned", (F.col("from_count") == 1) & F.col("from_bank").isNotNull() & (same("dkim", "dkim_ok") | same("env", "spf_ok")))


def address_local_part(df: DataFrame, handle: str, id_col: str) -> DataFrame:
    """A handle as a local part: lower case, other characters out; without one the id in base 36."""
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(handle), F.lit(""))), "[^a-z0-9._-]", "")
    return df.withColumn("local_part", F.when(clean != "", clean).otherwise(F.concat(F.lit("u"), F.lower(F.conv(F.col(id_col).cast("string"), 10, 36)))))


def user_label(df: DataFrame, handle: str, first: str, id_col: str) -> DataFrame:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.withColumn("user_label", F.coalesce(F.concat(F.lit("@"), some(handle)), some(first), F.col(id_col).cast("string")))


def bucket_percent(df: DataFrame, key: str, pct: int) -> DataFrame:
    """`bucket`: sha256 of the key modulo 100, exact; `chosen` where it is below pct."""
    digits = F.transform(F.split(F.sha2(F.col(key).cast("string"), 256), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    value = F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda acc, d: (acc * 16 + d) % 100)
    return df.withColumn("bucket", value.cast("long")).withColumn("chosen", F.col("bucket") < pct)


def type_gate(df: DataFrame, name: str, content: str, *, ext: str, magic: str) -> DataFrame:
    """Rows whose name ends in the extension or whose content starts with the magic."""
    return df.filter(F.lower(name).endswith(ext) | F.startswith(F.col(content), F.lit(magic)))


def usable_rows(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """Rows for which every test is true; null is no."""
    for t in tests:
        df = df.filter(F.coalesce(t, F.lit(False)))
    return df


def clean_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as doubles; what is no finite number is null."""
    for c in cols:
        x = F.col(c).try_cast("double")
        df = df.withColumn(c, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    return df


def status_class(df: DataFrame, text: str, *, failed: str, pending: str, success: str, out: str = "status") -> DataFrame:
    t = F.col(text)
    return df.withColumn(out, F.when(t.rlike(failed), "failed").when(t.rlike(pending), "pending").when(t.rlike(success), "success").otherwise("unknown"))


def status_conflict(df: DataFrame, doc: str, text: str, classes: Mapping[str, str]) -> DataFrame:
    """(doc, classes, conflict): the final classes whose phrase a text has; more than one is a conflict."""
    held = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in sorted(classes.items())]))
    return df.select(doc, F.array_join(held, ",").alias("classes"), (F.size(held) > 1).alias("conflict"))


def document_router(df: DataFrame, text: str, markers: Mapping[str, Sequence[str]], *, need: int = 1) -> DataFrame:
    """`route`: the kind with most marker hits, the first named on ties, if it has enough; else unknown."""
    hits = {k: sum((F.contains(F.col(text), F.lit(m)).cast("int") for m in ms), F.lit(0)) for k, ms in markers.items()}
    best = F.greatest(*hits.values(), F.lit(0))
    route = F.lit("unknown")
    for k, h in reversed(hits.items()):
        route = F.when((h == best) & (h >= need), k).otherwise(route)
    return df.withColumn("route", route)


#: Profiles that each document is held against.
MAX_PROFILES = 2_000


def issuer_identify(df: DataFrame, doc: str, text: str, producer: str, profiles: DataFrame, *, min_score: float = 0.5) -> DataFrame:
    """(doc, issuer, score): the profile with the highest share of its text markers and producers found.

    `profiles` is a rule table (issuer, ord, markers, producers, exclusive) of MAX_PROFILES rows at most, as each document is held against all; without rules
    every document has none. An exclusive marker gives 1; without any
    text marker the score is at most 0.55; ties go to the smaller ord; below min_score there is none.
    """
    if profiles.limit(MAX_PROFILES + 1).count() > MAX_PROFILES:
        raise ValueError(f"there may be {MAX_PROFILES} profiles at most")
    rules = profiles.agg(F.collect_list(F.struct("issuer", "ord", "markers", "producers", "exclusive"))).scalar()
    x = df.select(doc, F.col(text).alias("_t"), F.coalesce(F.col(producer), F.lit("")).alias("_p"), rules.alias("_rules"))
    hits = lambda words, where: F.size(F.filter(words, lambda w: F.contains(where, w)))

    def scored(r):
        m, p = hits(r["markers"], F.col("_t")), hits(r["producers"], F.col("_p"))
        share = (m + p) / F.greatest(F.size(r["markers"]) + F.size(r["producers"]), F.lit(1))
        score = F.when(hits(r["exclusive"], F.col("_t")) > 0, 1.0).when(m == 0, F.least(share, F.lit(0.55))).otherwise(share)
        return F.struct(score.alias("score"), (-r["ord"]).alias("o"), r["issuer"].alias("issuer"))

    best = x.select(doc, F.array_max(F.transform("_rules", scored)).alias("b")).groupBy(doc).agg(F.max("b").alias("b"))
    return best.select(doc, F.when(F.col("b.score") >= min_score, F.col("b.issuer")).alias("issuer"), F.round("b.score", 6).alias("score"))


def channel_subtype(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str]], *, default: tuple[str, str] = ("other", "")) -> DataFrame:
    """`channel` and `subtype` of the first rule (pattern, channel, subtype) that matches."""
    channel, subtype = F.lit(default[0]), F.lit(default[1])
    for pattern, c, s in reversed(rules):
        hit = F.col(text).rlike(pattern)
        channel, subtype = F.when(hit, c).otherwise(channel), F.when(hit, s).otherwise(subtype)
    return df.withColumn("channel", channel).withColumn("subtype", subtype)


def emitter_vote(layers: DataFrame, doc: str, vote: str, a: str, b: str, *, need: int = 2) -> DataFrame:
    """(doc, votes_a, votes_b, emitter): conflict where both have votes, else the one with enough, else unknown."""
    n = layers.groupBy(doc).agg(F.count_if(F.col(vote) == a).alias("votes_a"), F.count_if(F.col(vote) == b).alias("votes_b"))
    va, vb = F.col("votes_a"), F.col("votes_b")
    return n.withColumn("emitter", F.when((va > 0) & (vb > 0), "conflict").when(va >= need, a).when(vb >= need, b).otherwise("unknown"))


def producer_lists(df: DataFrame, producer: str, allow: Sequence[str], deny: Sequence[str]) -> DataFrame:
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(producer), w))
    return df.withColumn("producer_class", F.when(has(deny), "foreign").when(has(allow), "own").otherwise("unknown"))


def field_contract(df: DataFrame, doc: str, method: str, fields: Sequence[str], contracts: DataFrame) -> DataFrame:
    """(doc, missing, unexpected): fields that the method's contract (method, required, forbidden) asks for or forbids."""
    present = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.lit(f)) for f in fields]))
    x = df.select(doc, F.col(method).alias("method"), present.alias("_p")).join(contracts, "method")
    return x.select(doc, F.array_join(F.array_sort(F.array_except("required", "_p")), ",").alias("missing"), F.array_join(F.array_sort(F.array_intersect("forbidden", "_p")), ",").alias("unexpected"))


def mixed_methods(df: DataFrame, doc: str, evidence: Mapping[str, Column]) -> DataFrame:
    """(doc, methods, mixed): field families proven in one document."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in sorted(evidence.items())]))
    return df.select(doc, F.array_join(held, ",").alias("methods"), (F.size(held) > 1).alias("mixed"))


def label_value_binding(df: DataFrame, doc: str, text: str, types: Mapping[str, str], *, min_bad: int = 2) -> DataFrame:
    """(doc, bad, decisive): labels whose next line that isn't empty doesn't match the label's type (label, pattern)."""
    lines = df.select(doc, F.posexplode(F.split(text, "\n")).alias("_at", "_l")).filter(F.trim("_l") != "")
    after = lines.withColumn("_v", F.lead("_l").over(Window.partitionBy(doc).orderBy("_at")))
    good = F.lit(None).cast("boolean")
    for label, pattern in types.items():
        good = F.when(F.trim("_l").startswith(label), F.coalesce(F.trim("_v"), F.lit("")).rlike(pattern)).otherwise(good)
    return after.withColumn("_ok", good).groupBy(doc).agg(F.count_if(~F.col("_ok")).alias("bad")).withColumn("decisive", F.col("bad") >= min_bad)


def active_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from start to end, both included."""
    kind = dict(df.dtypes)[ts]
    return df.filter(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def blocklist_filter(df: DataFrame, user: str, handle: str, blocked: DataFrame) -> DataFrame:
    """Rows whose user is not blocked by id, nor by handle in any case; `blocked` is (user, handle)."""
    ids = blocked.filter("user is not null").select(F.col("user").alias("_u")).distinct()
    names = blocked.filter("handle is not null").select(F.lower("handle").alias("_h")).distinct()
    return df.join(ids, df[user] == ids["_u"], "left_anti").join(names, F.lower(df[handle]) == names["_h"], "left_anti")


def stale_filter(df: DataFrame, text: str, *, as_of: str, days: int = 30, footer: str | None = None) -> DataFrame:
    """Rows whose newest dd.mm.yyyy is no older than so many days; rows without a date stay. The footer's text doesn't count."""
    body = F.split(F.col(text), footer)[0] if footer else F.col(text)
    dates = F.transform(F.regexp_extract_all(body, F.lit(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), F.lit(0)), lambda d: F.try_to_timestamp(d, F.lit("dd.MM.yyyy")).cast("date"))
    newest = F.array_max(dates)
    return df.filter(newest.isNull() | (F.datediff(F.lit(as_of).cast("date"), newest) <= days))
