"""Line dedup by distinct-site spread.

A line is boilerplate when it stands on enough distinct sites: `min_sites`, or `long_sites` for a line of
`long_words` words, which hardly stands on a few sites by chance. Each line hash keeps a HyperLogLog sketch
of its sites and its first place, merged by aggregation before and after the shuffle; lines whose estimate
falls near the threshold get an exact distinct count. All places of a boilerplate line but the first (by
document id, then place) are then taken out, so a text that whole sites copy stays once. The places of a
line are met with it in one join that nothing else shares a stage with, so Spark splits a line that stands
on every page over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, fresh, once, whole

#: Distinct sites from which a line is boilerplate, and characters (trimmed) below which lines are left alone.
MIN_SITES, MIN_CHARS = 10, 12
#: Words from which a line is a long one, and the sites that make it boilerplate.
LONG_WORDS, LONG_SITES = 50, 3
#: log2 of the sketch's buckets, and the relative errors of the estimate counted as near.
LG_K, NEAR = 12, 0.1


def _line_key(line: Column) -> list[Column]:
    """128 bits of a line, white space at its ends left out."""
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit("line"), line).alias("_h2")]


def _doc_key(doc: Column, text: Column) -> list[Column]:
    """Rows with one id and one text lose the same lines, so the pair names a document, null ids included."""
    return [F.coalesce(doc.cast("string"), F.lit("")), F.xxhash64(text, doc.isNull())]


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_chars: int = MIN_CHARS, min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> DataFrame:
    """(_d1, _d2, site, at, _h1, _h2, need): the lines of at least `min_chars` characters by hash, their place and the sites that make them boilerplate."""
    text = whole(F.col(text_col))
    d1, d2 = _doc_key(F.col(id_col), text)
    # keys are made below the generator: in one select with it they would hash the whole text again for each line
    rows = docs.select(d1.alias("_d1"), d2.alias("_d2"), F.col(id_col).alias("doc"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.split(text, "\n").alias("lines"))
    rows = rows.select("_d1", "_d2", "doc", "site", F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter(F.length("line") >= min_chars)
    # so many words have as many characters at least
    is_long = (F.length("line") >= long_words) & (F.size(F.split("line", r"[ \t\r]+")) >= long_words)
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "_d2", "pos")
    return rows.select("_d1", "_d2", "site", at.alias("at"), *_line_key(F.col("line")), F.when(is_long, long_sites).otherwise(min_sites).alias("need"))


def spread(found: DataFrame) -> DataFrame:
    """(_h1, _h2, first, sites): the lines on enough distinct sites, with their first place. Sites that are null count as one site, "".

    `sites` is the exact number for lines near the threshold and the sketch's estimate for the others.
    """
    need = F.col("need")
    low, high = F.least(need - 1, F.floor(need * (1 - NEAR))), F.greatest(need + 1, F.floor(need * (1 + NEAR)) + 1)
    sketched = found.groupBy("_h1", "_h2").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.min("at").alias("first"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    # a line that stands in fewer places than that can't be on so many sites
    sketched = sketched.filter(F.col("n") >= need).select("_h1", "_h2", "need", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    sketched = cut(sketched.filter(F.col("sites") >= low))
    near = sketched.filter(F.col("sites") <= high).select("_h1", "_h2", "need", "first")
    pairs = found.select("_h1", "_h2", "site").join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2", "site").agg(F.count("*").alias("n"))
    exact = pairs.groupBy("_h1", "_h2").agg(F.count("*").alias("sites")).join(near, ["_h1", "_h2"]).filter(F.col("sites") >= need)
    return sketched.filter(F.col("sites") > high).select("_h1", "_h2", "first", "sites").union(exact.select("_h1", "_h2", "first", "sites"))


def drop_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> DataFrame:
    """`docs` with the boilerplate lines taken out of `text_col`, but for the first place of each.

    All rows and columns stay, whatever the columns are called; a text that loses every line becomes empty,
    a null text stays null, and rows repeated with one id and text are one document. Lines keep their order;
    those that stay keep their white space. Ids that are null come after all others. An empty table stays so.
    """
    found = lines(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_chars=min_chars, min_sites=min_sites, long_words=long_words, long_sites=long_sites)
    common = cut(spread(found)).select("_h1", "_h2", "first")
    d1, d2, gone, split = fresh(docs, "d1", "d2", "gone", "split")
    places = found.join(common, ["_h1", "_h2"]).filter("at != first")
    dropped = places.groupBy(F.col("_d1").alias(d1), F.col("_d2").alias(d2)).agg(F.collect_set("at.pos").alias(gone))

    text = whole(F.col(text_col))
    keyed = docs.withColumns(dict(zip((d1, d2), _doc_key(F.col(id_col), text), strict=True)))
    # lines are looked up by the places that stay, which takes time in proportion to the lines, however many go
    cleaned = keyed.join(dropped, [d1, d2], "left").withColumn(split, once(F.when(F.col(gone).isNotNull(), F.split(text, "\n"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n")
    return cleaned.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
