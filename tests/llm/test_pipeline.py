"""The pipeline against its stages done plainly."""

import hashlib

from pyspark.sql import functions as F
from test_ops import ends
from test_similar import plain

import corpus_pipeline
from veridoc.llm import bpe, decontaminate, line_dedup, quality
from veridoc.llm.common import table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    """Whole rows, as they compare."""
    return sorted(map(repr, map(tuple, df.collect())))


def test_each_stage_equals_a_plain_version(spark):
    """Every stage on what the one before kept, whole rows both ways, and `run` against the last; the line stage has a test of its own."""
    docs = first = table(spark, SF, "documents")
    labels, items = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    kept = [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.scratch(stage(spark, docs, SF), "t")
        kept.append(docs.count())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        own = [(r["doc_id"], r["text"] or "") for r in before.collect()]
        stays = None
        if n == 0:
            w = quality.undump(quality.train(before, labels))
            stays = {d for d, t in own if quality.scores([t.encode()], w)[0] >= quality.THRESHOLD}
        if n == 2:  # all pairs of five-word shingles with a similarity of 0.8 or more
            stays = set(plain(own).values())
        if n == 3:  # the edit distance of every item to the best substring of every text
            hit = {d for d, t in own for i in items.collect() if matches(decontaminate.as_text(decontaminate.normalize(i["text"] or "")), decontaminate.as_text(decontaminate.normalize(t)))}
            stays = {d for d, _ in own} - hit
            assert hit
        if stays is not None:
            assert rows_of(docs) == rows_of(before.filter(F.col("doc_id").isin(sorted(stays))))
        if n == 4:
            t = bpe.load(bpe.TOKENIZER)
            ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in own}
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            want = [(d, len(i), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for d, i in ids.items()]
            assert sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in docs.collect()) == sorted(want)
    assert kept == sorted(kept, reverse=True) and kept[1] == kept[2] > kept[3] > kept[4] == kept[5]
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(docs)


def matches(item, text):
    """Whether the item is within its edits of a substring. A text that shares no piece of the item can't be: of edits + 1 pieces one is whole."""
    e = len(item) // 10
    size = len(item) // (e + 1)
    if not item or not any(item[k * size : (k + 1) * size] in text for k in range(e + 1)):
        return False
    return ends(item, text).min() <= e


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty texts, repeated rows and an extra column with an operator's own name go through each stage by itself."""
    docs = table(spark, SF, "documents")
    good = docs.join(table(spark, SF, "labels").filter("quality = 1"), "doc_id", "left_semi").orderBy(F.length("text").desc(), "doc_id")
    block = decontaminate.index([(r["item_id"], decontaminate.normalize(r["text"])) for r in table(spark, SF, "benchmark").collect()], decontaminate.EDIT_RATE)
    long = next(r for r in good.toLocalIterator() if not decontaminate.find(decontaminate.normalize(r["text"]), block))
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, " \n ", None, "s", 3), (-3, long["text"] + " and an end of its own", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*docs.columns).withColumn("node", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, SF)
        got = {r["doc_id"] for r in out.collect()}
        assert -3 in got and (name != "bpe encoding and decoding" or out.count() == 5), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    whole = docs.withColumn("node", F.lit("clash")).unionByName(odd)
    got = corpus_pipeline.quality_stage(spark, whole, SF)
    assert got.columns == whole.columns and -3 in {r["doc_id"] for r in got.collect()}


def test_line_stage_equals_a_plain_version(spark):
    """Lines of 12 characters on ten sites go, but for the first place of each by document and place; whole rows both ways."""
    docs = table(spark, SF, "documents")
    rows, sites, first = sorted(docs.collect(), key=lambda r: r["doc_id"]), {}, {}
    for r in rows:
        for n, line in enumerate((r["text"] or "").split("\n")):
            sites.setdefault(line.strip(" "), set()).add(r["source"])
            first.setdefault(line.strip(" "), (r["doc_id"], n))
    common = {line for line, s in sites.items() if len(line) >= line_dedup.MIN_CHARS and len(s) >= line_dedup.MIN_SITES}
    want = []
    for r in rows:
        kept = (x for n, x in enumerate((r["text"] or "").split("\n")) if x.strip(" ") not in common or first[x.strip(" ")] == (r["doc_id"], n))
        text = "\n".join(kept)
        want.append({**r.asDict(), "text": text, "n_chars": len(text)})
    got = [r.asDict() for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).orderBy("doc_id").collect()]
    assert got == want and common
