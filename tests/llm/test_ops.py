"""The corpus operators against brute-force versions and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import bpe, chat, decontaminate, license_scan, line_dedup, pii, quality, queries, sharding, simhash, topk
from veridoc.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t ", "a", "é", "<|startoftext|> x<|endoftext|>é" * 40, "x" * 20000, "ab cd, " * 3000, "W̊ ́a b c" * 200, "日本語" * 3000, "a@b.co +1 (017) 555-7713 4111 1111 1111 1111 1.2.3.4.5.6.7.8",
    "Released under the MIT License.\nAll rights reserved.", "cc by cc by", "\n\n\n", "1!" + "!" * 9000 + "a", "\x00\x1f \x7f",
]


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table, the odd texts, some of them twice, one without an id, and columns whose names operators use inside."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = [(10_000 + i, t, "srcX" if i % 2 else None) for i, t in enumerate(ODD)]
    odd += [odd[4], (None, "a b c d", "srcY"), (None, None, None)]
    both = real.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    return both.withColumn("fp", F.lit("x")).withColumn("words", F.lit(1)).withColumn("ids", F.lit(2.0)).withColumn("line", F.lit("y")).withColumn("component_id", F.lit(3)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_license_scan(docs, rows, none):
    got = sorted(map(repr, map(tuple, license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())))
    split = lambda t: [w for w in re.split(license_scan.SEPARATORS, lower(t)) if w]
    want = []
    for d, t, _ in rows:
        w, at, base, labels, best = split(t), [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            hit = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += hit
            base |= {label} if hit else set()
        for text, label in license_scan.TEMPLATES:
            need = set(split(text))
            step = next(x for x in (4, 8, 16, 32) if x >= 1.25 * len(need))
            for k in range(0, len(w), step):
                share = len(need & set(w[k : k + 2 * step])) / len(need)
                if share >= license_scan.THRESHOLD - 1e-9:
                    labels.add(label)
                    best = max(best, share)
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else best))
    assert got == sorted(map(repr, want))
    assert license_scan.license_scan(none).count() == 0


def test_wrapped_notices(spark):
    mit = "x y\n/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files, to deal */"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    far = "released " + "word " * 40 + "under the " + "word " * 40 + "mit license"  # its words stand in one line, but no notice
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(spark.createDataFrame(list(enumerate([mit, bsd, far])), "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "bsd", 2: ""}


def test_bpe_equals_the_library_and_round_trips(docs, rows, none):
    t = bpe.load(bpe.TOKENIZER)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, text, _ in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, map(tuple, bpe.encoded_digests(docs).collect()))) == sorted(map(repr, want))
    back = bpe.decode(bpe.encode(docs.filter("doc_id >= 10000"))).collect()
    assert all(r["decoded"] == t.decode(r["ids"], skip_special_tokens=False) for r in back) and len(back) == len(ODD) + 1
    assert bpe.encoded_digests(none).count() == 0


def test_bpe_reuses_bodies_exactly():
    """Texts with chunks that were encoded elsewhere, cut inside words, marks and punctuation, have the library's ids."""
    r, enc = random.Random(8), bpe._encoder(bpe.TOKENIZER)
    unit = lambda: r.choice(["Word", "the", "x9.", "É", "́", "W̊", "日本", "don't,", "...", "<|endoftext|>", "a<", "|b", "\t", "\n ", "ß."])
    text = lambda n: "".join(unit() + r.choice(["", " ", " "]) for _ in range(n))
    shared = [text(700) for _ in range(4)]
    texts = ["".join(r.choice([*shared, text(30)]) for _ in range(5)).encode() for _ in range(25)]
    ready = {}
    for x in {c for t in shared for c in bpe.chunks(t.encode())} | {c for t in texts for c in bpe.chunks(t)}:
        words = bpe.simple_words(x[at[0] : at[1]]) if (at := bpe.body_of(x)) else []
        enc.learn(set(words))
        ready[bpe.chunk_id(x)] = enc.words(words)
    got = bpe.encode_texts(texts, [{k: v for k, v in ready.items() if r.random() < 0.7} for _ in texts], enc)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == enc.tokenizer.encode(t.decode(), add_special_tokens=False).ids
    assert any(body is not None for p in (bpe.pieces_of(t, ready)[0] for t in texts) for _, body in p)


def test_bpe_joins_that_disagree_are_encoded_whole(monkeypatch):
    enc = bpe._encoder(bpe.TOKENIZER)
    text = b"one two three " * 200
    ready = {bpe.chunk_id(c): b"\1\0" for c in bpe.chunks(text)}  # bodies aren't looked into, joins are
    monkeypatch.setattr(enc, "words", lambda words, f=enc.words: f(words) + b"\0\0" * (words == [b"two"]))
    assert bpe.encode_texts([text], [ready], enc)[0].tolist() == enc.tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_bpe_chunks_follow_the_content():
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh ") for _ in range(9000)).encode()
    a, b = (set(bpe.chunks(head + passage)) for head in (b"one start " * 40, b"another, longer start " * 60))
    assert b"".join(bpe.chunks(passage)) == passage and len(a & b) > len(a) / 2
    assert all("".join(x.decode() for x in bpe.chunks(t.encode())) == t for t in ODD if t)


def test_sharding_keeps_every_row_and_commits_once(spark, docs):
    data = sharding.ShardedDataset(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", target_bytes=200_000, fanout=3, least_bytes=8_000)
    for k in range(3):
        data.append(docs.filter(F.coalesce("doc_id", F.lit(0)) % 3 == k), arrival_rows=10)
    before = data.versions()[-1]
    small = data.manifest().count()
    data.compact()
    assert data.manifest().count() < small and data.read().exceptAll(docs).isEmpty() and docs.exceptAll(data.read()).isEmpty()
    assert data.read(before).count() == docs.count()  # older versions stay readable until the vacuum
    assert data.manifest().agg(F.sum("n_rows")).head()[0] == docs.count()
    data.append(docs.limit(0))
    assert data.vacuum() == 0  # files so young may belong to a writer about to commit
    assert data.vacuum(older_than_s=0) > 0 and data.read().count() == docs.count()
    assert sharding.placed(data).count() == docs.count()
    with pytest.raises(ValueError):
        sharding.placed(data, into="Line")
    empty = sharding.ShardedDataset(spark, f"{data.root}-empty")
    with pytest.raises(ValueError):
        empty.read()
    empty.append(docs.limit(0))
    assert empty.compact() == 1 and empty.read().columns == docs.columns and sharding.placed(empty).count() == 0


def test_sharding_tiers_equal_a_plain_version(spark, docs):
    """From version to version: exactly the shards of full tiers go, the new ones hold their rows, and it ends when no tier is full."""
    target, fanout, least = 400_000, 2, 2_000
    data = sharding.ShardedDataset(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", target_bytes=target, fanout=fanout, least_bytes=least)
    for k in range(4):
        data.append(docs.filter(F.coalesce("doc_id", F.lit(0)) % 4 == k), arrival_rows=4 + 9 * k)

    def tier(size):
        t = 0
        while size > least * fanout**t:
            t += 1
        return -1 if 2 * size >= target else t

    def full(shards):
        by = defaultdict(list)
        for s in shards.values():
            by[tier(s["bytes"])].append(s["bytes"])
        return {t for t, sizes in by.items() if t >= 0 and (len(sizes) >= fanout or len(sizes) > 1 and sum(sizes) >= target)}

    first = data.versions()[-1]
    last, rounds = data.compact(), 0
    now = {s["shard"]: s for s in data.manifest(first).collect()}
    for version in range(first + 1, last + 1):
        merged = full(now)
        after = {s["shard"]: s for s in data.manifest(version).collect()}
        gone = {n: s for n, s in now.items() if tier(s["bytes"]) in merged}
        assert merged and now.keys() - after.keys() == gone.keys() and all(s["tier"] == tier(s["bytes"]) for s in after.values())
        assert sum(after[n]["n_rows"] for n in after.keys() - now.keys()) == sum(s["n_rows"] for s in gone.values())
        now, rounds = after, rounds + 1
    assert rounds > 1 and not full(now) and data.read().exceptAll(docs).isEmpty() and docs.exceptAll(data.read()).isEmpty()


def test_sharding_loses_no_arrival_of_another_writer(spark):
    root, rows = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", lambda a, b: spark.range(a, b).withColumn("bytes", F.lit("clash")).withColumn("tier", F.lit(None).cast("string"))
    a, b = (sharding.ShardedDataset(spark, root, target_bytes=200_000, fanout=2) for _ in range(2))
    for k in range(3):
        a.append(rows(10 * k, 10 * k + 10))
    write = a._write
    meanwhile = [lambda: b.append(rows(30, 40)), b.compact, lambda: b.append(rows(40, 50))]

    def slow(*x):
        out = write(*x)
        if meanwhile:
            meanwhile.pop(0)()
        return out

    a._write = slow
    a.compact()
    a.append(rows(50, 60))
    assert not meanwhile and sorted(r["id"] for r in a.read().collect()) == list(range(60)) == sorted(r["id"] for r in sharding.placed(b).collect())
    known = sharding.ShardedDataset.versions
    stale = [known(b)[-2]]
    b.versions = lambda: [stale.pop()] if stale else known(b)  # another writer commits between reading and renaming
    b.append(rows(60, 70))
    assert sorted(r["id"] for r in a.read().collect()) == list(range(70))


def test_line_dedup(docs, rows, none):
    sites, places = defaultdict(set), defaultdict(list)
    for d, t, s in rows:
        for p, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= line_dedup.MIN_CHARS:
                sites[line.strip(" ")].add(s or "")
                places[line.strip(" ")].append((d is None, d or 0, t, p))
    first = {}
    for line, s in sites.items():
        if len(s) >= (3 if len(re.split(r"[ \t\r]+", line.strip(" "))) >= 20 else 5):
            f = min((x[0], x[1], x[3]) for x in places[line])
            first[line] = f
    want = []
    for d, t, _ in rows:
        keep = []
        for p, line in enumerate(t.split("\n")):
            f = first.get(line.strip(" "))
            if f is None or f == (d is None, d or 0, p):
                keep.append(line)
        want.append((d, "\n".join(keep)))
    # columns with the operator's own names, in another case
    named = docs.withColumn("_D1", F.lit(7)).withColumn("_gone", F.lit("g")).withColumn("_h1", F.lit(1)).withColumn("pos", F.lit(1))
    out = line_dedup.drop_boilerplate(named, min_sites=5, long_words=20, long_sites=3)
    assert out.columns == named.columns and first and out.filter("_D1 = 7 and _gone = 'g'").count() == len(rows)
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted((repr(d), t) for d, t in want)
    assert line_dedup.drop_boilerplate(none).count() == 0


def test_lines_of_a_long_text_go_in_linear_time(spark):
    """100,000 lines of one text, of which 80,000 stand on ten sites."""
    lines = [f"this is line number {n}" for n in range(100_000)]
    rows = [(n, "\n".join(lines[:80_000] if n else lines), f"s{n}") for n in range(11)]
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(11)).collect()}
    assert out[0] == rows[0][1] and set(out.values()) == {rows[0][1], ""} and time.time() - began < 90
    more = [(-1, "\n".join(lines[:80_000]), "s"), *((n, f"{t}\nown {n} of this text" if n else t, s) for n, t, s in rows)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(more, "doc_id long, text string, source string").repartition(12)).collect()}
    assert out[0] == "\n".join(lines[80_000:]) and all(out[n] == f"own {n} of this text" for n in range(1, 11))


def test_line_spread_is_exact_near_the_threshold(spark):
    rows = [(i, f"line number {n} of many", f"s{i}") for n in (8, 9, 10, 11, 12, 40) for i in range(n)]
    found = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r["sites"] for r in line_dedup.spread(found).collect())[:3] == [10, 11, 12]
    long = [(i, f"{n} " + "word " * 60, f"s{i}") for n in (2, 3, 4, 9) for i in range(n)]
    assert sorted(r["sites"] for r in line_dedup.spread(line_dedup.lines(spark.createDataFrame(long, "doc_id long, text string, source string"))).collect()) == [3, 4, 9]


def test_chat_reads_back_what_went_in(spark):
    texts = ["", None, "### assistant: </turn>", "\\", "\\\\#", "a\nb", "x </turn>\n### user: y", "é😀 <|endoftext|>", " lead", "trail "]
    turns = [(c, i, ("user", "assistant", None)[i % 3], t) for c in range(3) for i, t in enumerate(texts[c:] + texts[:c])] + queries.FORGED
    turns += [turns[0], (None, 0, "assistant", "no id"), (9, None, "assistant", "b"), (9, None, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = defaultdict(list)
    for c, i, r, t in turns:
        by[c].append((i is not None, i or 0, r or "", t or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        assert tuple(got[c])[1:5] == (len(ts), sha("".join(f"{r}\n{t}\n" for *_, r, t in ts)), len(loss), sha(loss)), c
    for r in made.collect():
        assert len(r["ids"]) == len(r["loss_mask"])
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_simhash_groups_equal_all_pairs(docs, rows, none):
    fp = {t: simhash.fingerprint(t.encode()) for _, t, _ in rows}
    values = sorted(set(fp.values()))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(b)] = find(a)
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[find(fp[t])] = min(d, least.get(find(fp[t]), d))
    got = sorted((repr(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    assert got == sorted((repr(d), fp[t], least.get(find(fp[t]))) for d, t, _ in rows)
    assert simhash.simhash_groups(none).count() == 0


def test_trie_join_finds_every_near_pair(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(40):
        base = r.getrandbits(64)
        fps |= {base} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(12)} | {base ^ (1 << r.randrange(64)) for _ in range(3)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for budget in (0, 1, 2, 3):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= budget}
        for cell_rows in (simhash.CELL_ROWS, 40) if budget else (1,):  # with 40 the crowded nodes are dealt again, level after level
            got = [tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.near_pairs(df, budget=budget, cell_rows=cell_rows).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_walk_of_words_that_repeat():
    r = np.random.default_rng(6)
    a = simhash.Trie(np.sort(np.concatenate([np.full(300, 7), r.integers(0, 1 << 16, 500)]).astype(np.uint64)), 16)
    b = simhash.Trie(np.sort(r.integers(0, 1 << 16, 400).astype(np.uint64)), 16)
    for x, y in ((a, a), (a, b)):
        apart = np.bitwise_count(x.fps[:, None] ^ y.fps[None, :])
        want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(apart <= 2)), strict=True) if x is not y or i < j}
        got = [(int(i), int(j)) for part in simhash.walk(x, y, 2) for i, j in zip(*part[:2], strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_paths(spark):
    r = random.Random(2)
    names = r.sample(range(10**6), 300)
    links = [(a, b) for a, b in zip(names[:200], names[1:200])] + [(a, b) for a, b in zip(names[200:], names[201:])]
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(links, "fa long, fb long")).collect()}
    assert got == {n: min(names[:200]) for n in names[:200]} | {n: min(names[200:]) for n in names[200:]}


def brute_pii(t):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for n, (k, form) in enumerate(forms.items()):
        for m in re.finditer(form, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), n, m.end(), k))
    return sorted(out)


def test_pii_base(docs, rows, none):
    got = sorted(map(repr, ((r["doc_id"], [(x["s"], x["n"], x["e"], x["kind"]) for x in r["base"]]) for r in pii.find_personal_data(docs).collect())))
    assert got == sorted(map(repr, ((d, brute_pii(t)) for d, t, _ in rows)))
    assert pii.digests(pii.find_personal_data(none)).count() == 0


def test_pii_overlapping_forms(spark):
    texts = ["a@b.c.d@e.f_x@e-f.g", "x@y.z-_a@b.c", "256.1.1.1 001.002.003.255 1.2.3", "+1+2 345 678 901 +1 2 3 .... 9 ((()) 12.", "日本 a@b.co 𝒳 +1 234 567 890 9" * 5, "4111-1111-1111-1112 4111-1111-1111-1111 12345678901"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        assert [(x["s"], x["n"], x["e"], x["kind"]) for x in r["base"]] == brute_pii(texts[r["doc_id"]])


def test_pii_contexts_find_unseen_identifiers(spark):
    good = [c for n in range(200) if brute_pii(c := str(4000000000000000 + 7919 * n))][:15]
    rows = [(i, f"he paid by card {c} today") for i, c in enumerate(good * 2)] + [(90, "she paid by card 4111111111111112 today"), (91, "part number 4111111111111112x and code 1234567890123456")]
    got = {r["doc_id"]: [(x["s"], x["e"], x["kind"]) for x in r["found"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90] == [(17, 33, "card")] and got[91] == []


def test_pii_contexts_of_grouped_and_long_identifiers(spark):
    grouped = lambda c: f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}"
    good = [c for n in range(200) if brute_pii(c := str(4000000000000000 + 7919 * n))][:12]
    rows = [(i, f"he paid by card {grouped(c)} today") for i, c in enumerate(good)]
    rows += [(100 + i, f"call me at +1 (01{i % 10}) 555-77{10 + i}, or mail {'x' * 60}{i}@mail{i}.org please") for i in range(12)]
    unseen = "paid by card 4111 1111 1111 1112 today"
    rows += [(200, unseen), (201, "see pages 12 100-2000 of it"), (202, "call me at (017) 555-7713, or mail " + "y" * 70 + "7777@host now")]
    got = {r["doc_id"]: [(x["s"], x["e"], x["kind"]) for x in r["found"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == [(13, 32, "card")] and got[201] == [] and all(got[i] == [] for i in range(12))


def brute_bootstrap(docs):
    """The method's spans, done plainly: instances by a scan of words, then the rounds of the graph."""
    places = []
    for d, t in docs:
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        k, base = 0, brute_pii(t)
        while k < len(words):
            s, e = words[k]
            first = k
            k += 1
            if not re.search("[0-9@]", t[s:e]):
                continue
            while k < len(words) and t[e - 1] in "0123456789)" and t[e : words[k][0]] == " " and re.fullmatch(r"\(?[0-9][0-9().-]*[,;:!?]?", t[slice(*words[k])]):
                e = words[k][1]
                k += 1
            value = re.sub(r"^[^A-Za-z0-9+]+", "", t[s:e])
            s = e - len(value)
            value = re.sub(r"[^A-Za-z0-9]+$", "", value)
            if len(value) >= 6 and (len(re.findall("[0-9]", value)) >= 4 or "@" in value):
                shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", value)))
                seed = next((n for b, n, c, _ in base if b < s + len(value) and c > s), None)
                places.append((d, s, s + len(value), value, (t[slice(*words[first - 1])].lower() if first else "", shape), seed))
    edges, seeds = {(p[4], p[3]) for p in places if p[4][0]}, {}
    for *_, value, _, seed in places:
        if seed is not None:
            seeds[value] = min(seed, seeds.get(value, 9))
    known = {v: (n, 1.0) for v, n in seeds.items()}
    for _ in range(pii.ROUNDS):
        hits, total, sure = defaultdict(float), defaultdict(int), defaultdict(lambda: 1.0)
        for pattern, value in edges:
            total[pattern] += 1
            if value in known:
                hits[pattern, known[value][0]] += known[value][1]
        good = {(p, n): h / total[p] for (p, n), h in hits.items() if h >= pii.MIN_SUPPORT and h / total[p] >= pii.CONFIDENT}
        for pattern, value in edges:
            for n in range(4):
                if (pattern, n) in good:
                    sure[value, n] *= 1 - min(good[pattern, n], 0.999)
        found = defaultdict(list)
        for (value, n), miss in sure.items():
            if 1 - miss >= pii.ACCEPTED:
                found[value].append((1 - miss, -n))
        for value, n in seeds.items():
            found[value].append((1.0, -n))
        known = {v: (-max(x)[1], max(x)[0]) for v, x in found.items()}
    out = defaultdict(set)
    for d, s, e, value, _, seed in places:
        if seed is None and value in known:
            out[d].add((s, e, pii.KINDS[known[value][0]]))
    return out


def test_pii_spans_equal_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    r = random.Random(9)
    cards = [c for n in range(300) if brute_pii(c := str(4000000000000000 + 7919 * n))][:25] + ["4111111111111112", "4222222222222223"]
    docs += [(-1 - n, f"x {r.choice(['card', 'visa', 'code'])} {cards[n % 27]} {r.choice(['', '(12) 34-56, ', 'id 12345678 '])}end") for n in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: {(x["s"], x["e"], x["kind"]) for x in r["found"]} for r in pii.find_personal_data(df).collect() if r["found"]}
    assert got == dict(brute_bootstrap(docs)) and got


def test_pii_many_matches_in_a_text(spark):
    text = "id 12345678 mail a@b.co and 1.2.3.4 then " * 25_000
    began = time.time()
    got = pii.digests(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).head()
    assert (got["n_email"], got["n_ip"]) == (25_000, 25_000) and time.time() - began < 60


def test_quality_gradients():
    w = quality.start()
    texts, y = [b"hello world " * 30, b"ab", b"", "zé ".encode() * 50], np.array([1, 0, 1, 0.0])
    g = quality.gradients(texts, y, w)

    def loss(w):
        z = quality.logits(texts, w).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    r = np.random.default_rng(0)
    for k in ("filters", "hidden", "out", "filter_bias", "out_bias"):
        i = tuple(r.integers(0, s) for s in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[k][i]) < 2e-3, k


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score(d, quality.train(d, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for k, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_on_odd_rows(spark, docs, none):
    w = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, w).collect()} == {0.5} and quality.score(none, w).count() == 0
    assert quality.keep_good(docs, w).columns == docs.columns
    # a text's score doesn't depend on its neighbours in a batch
    fitted = quality.start(3)
    texts = [t.encode() for t in ODD if t]
    together = quality.scores(texts, fitted)
    assert np.allclose(together, [quality.scores([t], fitted)[0] for t in texts], atol=1e-5)


def brute_top(vectors, wanted, k):
    out = set()
    for q, v in wanted:
        s = sorted((-int(np.dot(v, c)), i) for i, c in vectors if i != q)[:k]
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


def test_topk_equals_sorting(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = topk.whole_vectors(df)
    rows = [(r["vec_id"], np.floor(np.array(r["embedding"], np.float32).astype(float) * 64).astype(np.int64)) for r in df.collect()]
    got = topk.top_k(v.filter("vec_id % 20 = 0"), v, query_rows=7, candidate_rows=100, bins=64).collect()
    assert set(map(tuple, got)) == brute_top(rows, [x for x in rows if x[0] % 20 == 0], 20) and len(got) == 500


def test_topk_refuses_scores_beyond_64_bits():
    big = np.array([[1 << 31, 1 << 31]])
    assert topk._products(big, big // 4).tolist() == [[1 << 61]]
    with pytest.raises(OverflowError, match="smaller scale"):
        topk._products(big, big)


def test_topk_ties_nulls_and_few_candidates(spark):
    same = [(i, [1.0, 2.0]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(same + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    v = topk.whole_vectors(df)
    got = topk.top_k(v.filter("vec_id in (0, 7)"), v, query_rows=1, candidate_rows=9, k=5).collect()
    want = brute_top([(i, np.array([64, 128])) for i, _ in same], [(0, np.array([64, 128])), (7, np.array([64, 128]))], 5)
    assert set(map(tuple, got)) == want
    few = v.filter("vec_id < 3")
    assert topk.top_k(few, few, k=20).count() == 6 and topk.top_k(v.limit(0), v).count() == 0


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_equals_the_edit_distance():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcd ") for _ in range(n))
    hits = 0
    for _ in range(500):
        item = decontaminate.normalize(word(r.choice((r.randint(8, 60), r.randint(9, 16), r.randint(19, 24), r.randint(29, 33)))))
        if len(item) < 8:
            continue
        t = list(decontaminate.as_text(item))
        for _ in range(r.randint(0, 7)):
            k, what = r.randrange(max(1, len(t))), r.random()
            if what < 0.4 and t:
                t[k] = r.choice("abcd")
            elif what < 0.7 and t:
                del t[k]
            else:
                t.insert(k, r.choice("abcd"))
        text = decontaminate.normalize(word(r.randint(0, 50)) + "".join(t) + word(r.randint(0, 50)))
        index = decontaminate.index([(1, item)], decontaminate.EDIT_RATE)
        want = edits(decontaminate.as_text(item), decontaminate.as_text(text)) <= len(item) // 10
        hits += want
        assert bool(decontaminate.find(text, index)) == want
    assert hits > 50


def brute_matches(docs, items):
    """(doc, item): all pairs by the edit distance to the best substring, row by row of the alignment."""
    out = set()
    fold = lambda t: re.sub(r" +", " ", "".join(c.lower()[0] if c.isalnum() else " " for c in t)).strip()
    for d, t in {(r["doc_id"], fold(r["text"] or "")) for r in docs.collect()}:
        chars = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        for i, item in ((r["item_id"], fold(r["text"] or "")) for r in items.collect()):
            if hit := bool(item):
                row, at = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
                for k, c in enumerate(item):
                    new = np.concatenate([[k + 1], np.minimum(row[1:] + 1, row[:-1] + (chars != ord(c)))])
                    row = np.minimum.accumulate(new - at) + at
                hit = row.min() <= len(item) // 10
            if hit:
                out.add((d, i))
    return out


def ends(item, text):
    """For each place in the text the least edits of the item against a substring that ends there."""
    row, at, chars = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for k, c in enumerate(item):
        new = np.concatenate([[k + 1], np.minimum(row[1:] + 1, row[:-1] + (chars != ord(c)))])
        row = np.minimum.accumulate(new - at) + at
    return row


@pytest.mark.parametrize("size", [*range(1, 13), 25, 60])
def test_decontamination_tells_where_and_how_near(size):
    """Items of every length, inside words too, in short and long texts: what is told is a match, and every match is near one that is told."""
    r = random.Random(size)
    word = lambda n: "".join(r.choice("abcde ") for _ in range(n))
    for length in (0, 5, 60, 300, 6000):
        item = decontaminate.normalize("c" + word(size - 2).replace(" ", "a") + "d" * (size > 1))
        text = decontaminate.normalize("".join(r.choice([word(r.randrange(20)), "x" + decontaminate.as_text(item) + "y"]) for _ in range(length // 20)))
        e = size // 10
        best = ends(decontaminate.as_text(item), decontaminate.as_text(text))
        found = decontaminate.find(text, decontaminate.index([(7, item)], decontaminate.EDIT_RATE))
        for i, start, end, edits in found:
            assert i == 7 and start == max(0, end - size) and best[end] <= edits <= e
        told = np.array([end for *_, end, _ in found])
        for end in np.flatnonzero(best[1:] <= e) + 1:
            assert len(told) and np.abs(told - end).min() <= max(4, 7 * e)
        if length == 6000:
            assert len(found) > 20


def test_decontamination_of_the_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    long = docs.filter(F.length("text") >= 1500).orderBy(F.length("text").desc(), "doc_id").limit(12)  # the brute-force version is slow
    docs = docs.filter(F.length("text") < 1500).union(long)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == brute_matches(docs, items) and got


def test_decontamination_of_repetitive_texts():
    """Places of shared q-grams are counted in steps; a text of one phrase over and over ends soon."""
    item = decontaminate.normalize("ab cd " * 100)
    began = time.time()
    assert decontaminate.find(decontaminate.normalize("ab cd " * 20_000), decontaminate.index([(1, item)], 0.1))
    assert not decontaminate.find(decontaminate.normalize("ab ce " * 20_000), decontaminate.index([(1, item)], 0.1))
    assert time.time() - began < 60


def test_decontamination_of_tables(spark, docs, none):
    items = spark.createDataFrame([(1, docs.filter("doc_id = 3").head()["text"][:300]), (2, None), (3, ""), (4, "zz"), (5, "no such passage stands in any of these texts")], "item_id long, text string")
    planted = docs.unionByName(spark.createDataFrame([(77_777, "so zz, then", "s")], "doc_id long, text string, source string"), allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(planted, items, block_chars=50).collect()}
    assert got == brute_matches(planted, items) and {(3, 1), (77_777, 4)} <= got
    kept = decontaminate.decontaminate(planted, items)
    assert kept.columns == planted.columns and kept.filter("doc_id in (3, 77777)").isEmpty() and kept.filter("doc_id is null").count() == 2
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
