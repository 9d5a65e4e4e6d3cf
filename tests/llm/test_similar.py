"""Near copies against all pairs, done plainly."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from veridoc.llm import simhash


def shingled(text):
    ws = text.encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain(rows):
    """The smallest id of each row's group, over all pairs with a similarity of 0.8 or more."""
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    return {d: least[find(k)] for k, (d, _) in enumerate(rows)}


def planted():
    """Texts of 100 words; of each, copies at similarities on both sides of 0.8, chains of copies, and a passage in all."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage, texts = [word() for _ in range(40)], ["", " \n", "one two", "One  two", "two one"]
    for _ in range(12):
        base = [word() for _ in range(100)]
        texts.append(" ".join(passage + base))
        for cut in (10, 17, 18, 19, 20, 21, 25):
            texts.append(" ".join(passage + base[:-cut] + [word() for _ in range(r.choice((0, cut)))]))
        for at in range(20, 90, 20):
            texts.append(" ".join(passage + base[:at] + [word()] + base[at + 1 :]))
    r.shuffle(texts)
    return [(n, t) for n, t in enumerate(texts)]


def test_similar_groups_against_all_pairs(spark):
    """Nothing is joined that the exact rule keeps apart; nearly all that it drops goes."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("fp", F.lit(1))
    want, sets = plain(rows), {d: shingled(t) for d, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert set(got) == set(want) and all(want[got[d]] == want[d] for d in got)
    gone, dropped = ({d for d, c in groups.items() if c != d} for groups in (want, got))
    assert dropped <= gone and len(dropped) >= 0.97 * len(gone) and len(sets) > len(gone) > 100


def test_pipeline_stage_drops_planted_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(plain(rows).values())
    stay = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert want <= stay and len(stay) <= len(want) + 0.03 * len(rows)


def test_recall_on_the_table(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[c] == want[d] for d, c in got.items()) and sum(c != d for d, c in got.items()) >= 0.9 * sum(c != d for d, c in want.items())


def test_forest_joins_what_links_join():
    r = np.random.default_rng(4)
    i, j = r.integers(0, 300, 400), r.integers(0, 300, 400)
    forest = simhash.Forest(300)
    chosen = np.concatenate([forest.add(i[at : at + 50], j[at : at + 50]) for at in range(0, 400, 50)])
    all_links, few = simhash.Forest(300), simhash.Forest(300)
    all_links.add(i, j)
    assert few.add(i[chosen], j[chosen]).all()
    roots = [[f._root(x) for x in range(300)] for f in (all_links, few)]
    assert roots[0] == roots[1]


def test_clusters_join_what_all_pairs_join():
    """Crowds of one word with words after it near and far: the cell's links join the same sets as all its pairs, strong ones too."""
    r = np.random.default_rng(5)
    flips = lambda n, bits: np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, n).astype(np.uint64) for _ in range(bits)])
    for trial in range(6):
        word = np.concatenate([np.full(400, 12345), np.full(300, 12347), r.integers(0, 1 << 32, 50), np.full(20, 12349)]).astype(np.uint64)
        centre = r.integers(0, 1 << 63, 5).astype(np.uint64)
        after = centre[r.integers(0, 5, len(word))]
        for _ in range(3):
            after = after ^ np.where(r.random(len(word)) < 0.5, flips(len(word), 1 + trial % 3), np.uint64(0))
        other = r.random(len(word)) < 0.3
        cell = pa.table({"other": other, "word": word.view(np.int64), "next": after.view(np.int64), "node": r.permutation(len(word)) * 3})
        node = cell.column("node").to_numpy()
        apart = np.bitwise_count(word[:, None] ^ word).astype(int)
        more = np.bitwise_count(after[:, None] ^ after).astype(int)
        meets = (apart <= simhash.WORD_BUDGET) & (more <= simhash.NEXT_BUDGET) & ~(other[:, None] & other)
        got = simhash._meet_words(cell).to_pydict()
        index = {n: k for k, n in enumerate(node.tolist())}
        links = [(index[a], index[b]) for a, b in zip(got["fa"], got["fb"], strict=True)]
        assert len(links) < 3 * len(word)
        near = lambda a, b: (apart[a, b] <= simhash.WORD_BUDGET) & (more[a, b] <= simhash.NEXT_BUDGET)
        assert all(near(a, b) for a, b in links)
        strong = apart + more <= simhash.STRONG
        for want, chosen in ((meets, links), (meets & strong, [(a, b) for a, b in links if strong[a, b]])):
            sets = []
            for pairs in (np.argwhere(np.triu(want, 1)), np.array(chosen).reshape(-1, 2)):
                forest = simhash.Forest(len(word))
                forest.add(pairs[:, 0], pairs[:, 1])
                sets.append([forest._root(x) for x in range(len(word))])
            finer = {}  # links between two "other" rows of a crowd may join more, never less
            assert all(finer.setdefault(a, b) == b for a, b in zip(*sets, strict=True))


def near_the_threshold(pairs):
    """Texts of 100 words, each with a copy whose end differs: 10 or 11 of 96 shingles, similarities of 0.811 and 0.794; a passage that half of them have."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(50)], []
    for n in range(pairs):
        base = (passage if n % 2 else [word() for _ in range(50)]) + [word() for _ in range(50)]
        changed = 10 if n % 4 else 11
        texts += [" ".join(base), " ".join(base[:-changed] + [word() for _ in range(changed)])]
    return list(enumerate(texts))


def test_no_link_at_the_threshold_is_left_out(spark):
    """The tries alone miss some of these pairs."""
    rows = near_the_threshold(600)
    want = {n: n - n % 2 if n // 2 % 4 else n for n, _ in rows}
    assert plain(rows[:40]) == {n: want[n] for n in range(40)}
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == want


def test_planted_groups_equal_all_pairs(spark):
    rows = planted()
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == plain(rows)


def test_one_fingerprint_is_not_one_text(spark):
    """A shingle that most of a text repeats decides its fingerprint; the rest of the sets differ."""
    rows = [(n, "spam " * 200 + " ".join(f"w{n}x{k}" for k in range(30))) for n in range(4)]
    rows += [(4, rows[0][1]), (5, "spam " * 300 + rows[1][1])]
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1} == plain(rows)


def test_first_shingles_meet_in_all_similar_sets():
    """All pairs of similar sets with different roots share a shingle that lets them meet, in any order of the shingles; a large root is met by the others alone."""
    r = np.random.default_rng(8)
    for trial in range(4):
        sets = []
        for _ in range(120):
            base = sets[r.integers(len(sets))] if sets and r.random() < 0.7 else r.integers(0, 400, r.integers(1, 60))
            sets.append(np.unique(np.where(r.random(len(base)) < 0.08, r.integers(0, 400, len(base)), base)))
        order = r.permutation(400)
        root = np.where(r.random(120) < 0.5, 7, np.arange(120) if trial % 2 else r.integers(0, 20, 120))
        rows = []
        for n, x in enumerate(sets):
            first = x[np.argsort(order[x])][: len(x) // 5 + 1]
            rows += [(s, n, len(x), k, root[n]) for k, s in enumerate(first)]
        got = {(a, b) for found in simhash._meet_prefixes(*np.array(rows).T, (4, 5)) for a, b in zip(found[0].tolist(), found[1].tolist(), strict=True)}
        shared = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        want = {(a, b) for b in range(120) for a in range(b) if root[a] != root[b] and 9 * shared(a, b) >= 4 * (len(sets[a]) + len(sets[b]))}
        assert want <= got and len(want) > 20 and all(a < b and root[a] != root[b] for a, b in got)


def test_common_shingles_come_last(spark):
    """The commonest are told by whole levels within the room, and none of them is among the first of a text with enough others."""
    rows = spark.createDataFrame([(f"in all the texts there is this {' '.join(f'w{n}x{k}' for k in range(20))} {'and in half of them this' if n % 2 else ''}",) for n in range(40)], "text string").selectExpr("cast(text as binary) text").repartition(3)
    how = {"shingle": 5, "parts": 256}
    everywhere = {simhash._key(simhash.shingle_hashes(t, 5), 256)[0] for t in (b"in all the texts there", b"all the texts there is", b"the texts there is this")}
    common = simhash.common_shingles(rows, **how)
    assert len(common) == 5 and set(common[2:]) == everywhere
    assert set(simhash.common_shingles(rows, **how, most=4)) == everywhere and len(simhash.common_shingles(rows, **how, most=2)) == 0
    first = simhash._prefixes(rows, common, **how, similar=(4, 5)).collect()
    assert first and not {int(x) for x in common} & {int(simhash._key(np.array([x["s"]], np.int64).view(np.uint64), 256)[0]) for x in first}


def test_a_crowd_of_copies_ends_soon(spark):
    """20,000 copies of one text, each with a word of its own changed."""
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(240)]
    rows = []
    for n in range(20_000):
        at = r.randrange(240)
        rows.append((n, " ".join([*words[:at], f"x{n}", *words[at + 1 :]])))
    rows.append((20_000, " ".join(f"other{k}" for k in range(240))))
    began = time.time()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    groups = {}
    for x in simhash.similar_groups(docs).collect():
        groups[x["component_id"]] = groups.get(x["component_id"], 0) + 1
    assert groups == {0: 20_000, 20_000: 1} and time.time() - began < 240


def test_odd_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (None, "a b c d e f"), (1, "A b c d e  f"), (2, None), (4, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["1", "2", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == 0
