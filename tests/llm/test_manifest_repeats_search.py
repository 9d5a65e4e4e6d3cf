"""Operators 11 to 13 against plain versions, and rows that are odd."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import lexical, merkle, queries, repeats
from veridoc.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def up(level):
    return [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]


def plain_manifest(rows):
    """The contract of op11, with lists: a row's columns by its place in `rows`."""

    def leaf(r, more=0):
        values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def path(level, i):
        out = []
        while len(level) > 1:
            j = i ^ 1
            out.append((i, level[j] if j < len(level) else None))
            level, i = up(level), i // 2
        return level[0], out

    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k]))
    trees = {lang: sorted((k for k, r in enumerate(rows) if r[2] == lang), key=order) for lang in {r[2] for r in rows}}
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots = [path([leaf(rows[k]) for k in trees[x]], 0)[0] for x in langs]
    out = {}
    for x in langs:
        level = [leaf(rows[k]) for k in trees[x]]
        root, top = path(roots, langs.index(x))
        for i, k in enumerate(trees[x]):
            subroot, below = path(level, i)
            r = rows[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf(r, 1) if tampered else leaf(r)
            for at, sibling in below + top:
                h = sha(h if sibling is None else sibling + h if at % 2 else h + sibling)
            out[k] = (r[0], leaf(r), subroot, root, sha("".join(s for _, s in below + top if s)), h, h == root)
    return [out[k] for k in range(len(rows))]


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 5, 8), (9, 256, 257, 1), (700, 31)])
def test_manifest_equals_a_plain_version(spark, sizes):
    langs = ["en", None, "", "é", "zz"]
    r, rows = random.Random(len(sizes)), []
    for lang, n in zip(langs, sizes, strict=False):
        rows += [(r.choice([None, *range(900)]), r.choice([None, "", "x:1", "ü" * 3]), lang, r.choice(["s", None]), r.choice([None, 1, 70])) for _ in range(n)]
    rows += rows[:2]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("idx", F.lit("clash")).withColumn("h", F.lit(3)).withColumn("tree", F.lit(1))
    got = [tuple(x[c] for c in COLS) for x in merkle.checked_manifest(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_the_table_and_of_nothing(spark):
    docs = table(spark, SF, "documents")
    got = sorted(tuple(x[c] for c in COLS) for x in queries.op11_merkle(spark, SF).collect())
    assert got == sorted(plain_manifest([tuple(x[c.split()[0]] for c in DOCS.split(", ")) for x in docs.collect()]))
    assert merkle.checked_manifest(docs.limit(0)).collect() == []


def brute(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        gone = np.cumsum(m)[:-1] > 0
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


REPEATS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def check_repeats(spark, texts, **how):
    rows = [(None if n % 7 == 3 else n // 2, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_", F.lit(1)).withColumn("d1", F.lit("clash"))
    got = [(x["doc_id"], *(x[c] for c in REPEATS)) for x in repeats.digests(repeats.drop_repeats(docs.repartition(5), **how)).collect()]
    want = brute([(t or "").encode() for t in texts], how.get("length", repeats.LENGTH))
    assert sorted(map(repr, got)) == sorted(repr((d, *w)) for (d, _), w in zip(rows, want, strict=True))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_all_windows(spark, seed):
    """Small alphabets, planted passages whole and cut, runs of one letter, repeats of whole rows; crowds of two are split to the end."""
    r = random.Random(seed)
    letters, length = r.choice(["ab", "abcé", "abcdefghijklmnop"]), r.choice([8, 21, 40])
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [some(r.choice([0, length - 1, length, 120])) for _ in range(25)] + [None, "", "a" * 90, "ab" * 60]
    passages = [some(r.choice([length, 3 * length])) for _ in range(3)]
    texts += ["".join(r.choice([r.choice(passages), r.choice(passages)[:-3], some(r.randrange(20))]) for _ in range(5)) for _ in range(30)]
    texts += texts[-2:]
    got = check_repeats(spark, texts, length=length, gram=max(1, length // 4), crowd=r.choice([2, 512]))
    assert any(x[2] for x in got)


def test_a_passage_in_many_texts_is_split(spark):
    """One passage between words that differ: its first and last anchors have a piece for every text, far more than one bucket takes."""
    r = random.Random(5)
    some = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    passage = some(90)
    texts = [f"{some(60)} {passage} {some(70)}" for _ in range(150)] + [some(100)]
    got = check_repeats(spark, texts, crowd=16)
    assert sum(x[2] >= len(passage) for x in got) == 150


def test_repeats_of_the_table(spark):
    texts = [(x["doc_id"], x["text"] or "") for x in table(spark, SF, "documents").collect()]
    want = brute([t.encode() for _, t in texts], repeats.LENGTH)
    got = sorted((x["doc_id"], *(x[c] for c in REPEATS)) for x in queries.op12_repeats(spark, SF).collect())
    assert got == sorted((d, *w) for (d, _), w in zip(texts, want, strict=True)) and sum(x[2] > 0 for x in got) > 5


def test_repeat_groups_hold_equal_strings_and_all_their_places(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = some(80)
    texts = [some(60) + passage[r.choice([0, 0, 5]) :] + some(50) for _ in range(12)]
    rows = spark.createDataFrame([(n, n, t.encode()) for n, t in enumerate(texts)], "d1 long, d2 long, text binary")
    groups = defaultdict(set)
    for x in repeats.repeat_groups(rows, length=40, gram=10).collect():
        groups[x["g"]].add((x["d1"], x["start"], x["m"]))
    for members in groups.values():
        strings = {texts[d][a : a + m] for d, a, m in members}
        assert len(strings) == 1 and len(members) > 1
    # strings that stand in all texts have a place in each
    assert any(len({d for d, *_ in members}) == 12 for members in groups.values())


def test_long_text_and_empty_table(spark):
    r = random.Random(1)
    long = "".join(chr(97 + x) for x in (r.randrange(26) for _ in range(3 * repeats.SLAB)))
    texts = [long, long[repeats.SLAB - 700 : repeats.SLAB + 900], "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.digests(repeats.drop_repeats(docs)).collect()}
    assert got == {0: (1600, 1), 1: (1600, 1), 2: (0, 0)}
    assert repeats.drop_repeats(docs.limit(0)).collect() == []


def plain_search(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(words(t))) for d, t in docs]
    all_docs, all_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, query in items.items():
        found = []
        for d, c in counts:
            score = 0
            for t in (t for text in query for t in words(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * c.total() * all_docs // all_terms)))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, n + 1, None if none else d, -s) for n, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def test_search_equals_a_plain_version(spark):
    r = random.Random(2)
    some = lambda n: "".join(r.choice(["alpha", "Beta", "ÄÖ", "x1", "的", "gamma", "_", " ", ",", " ", "\x7f"]) for _ in range(n))
    docs = [(r.choice([None, *range(50)]), r.choice([None, "", "...", some(r.randrange(40))])) for _ in range(150)]
    docs += docs[:30] + [(77, "alpha " * 30_000)]
    items = [(1, "alpha beta beta"), (2, None), (1, "GAMMA"), (None, "x1 的"), (3, "nowhere"), (4, some(30)), (5, "_")]
    asked = defaultdict(list)
    for i, t in items:
        asked[i].append(t)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("score", F.lit("clash")).repartition(6)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(9))
    for how in ({}, {"block_bytes": 8}, {"k": 3}):
        got = lexical.ranked(d, i, **how)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_search(docs, asked, how.get("k", 20))))
    assert lexical.ranked(d.limit(0), i).collect() == [] and lexical.ranked(d, i.limit(0)).collect() == []


def test_scores_beyond_floating_point_are_exact():
    counts = [(1, Counter({b"a": 1 << 30, b"b": 3}))]
    known = lexical.index([(n, Counter({b"a": 1 << 33, b"b": 1})) for n, _ in counts])
    items, scores = lexical.scored(Counter({b"a": 5, b"b": 2}), 7, known, np.array([3, 1]), 10, 100)
    m = 75 + 25 * 7 * 10 // 100
    assert scores.tolist() == [(1 << 33) * 3 * (5 * 10**9 // (5000 + 12 * m)) + 2 * 10**9 // (2000 + 12 * m)] and items.tolist() == [0]
