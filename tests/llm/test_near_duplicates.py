"""Near duplicates against all pairs, their weights and samples, and the blocks and joins that they rest on."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from aeroquilt.llm import blocks, common, line_dedup, near_dup
from tests.llm.test_llm import prose


def brute_classes(texts, least):
    """Classes of places and links, by weighted Jaccard similarity of all pairs that share a shingle; equal texts are linked."""
    words = [(t or "").lower().split() for t in texts]
    grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter() for w in words]
    held, at = collections.Counter(g for c in grams for g in c), collections.defaultdict(list)
    weights = [{g: x * (1 + np.log(len(texts) / held[g]) / np.log(len(texts) + 1)) for g, x in c.items()} for c in grams]
    total, root = [sum(w.values()) for w in weights], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for i, w in enumerate(weights):
        both = collections.Counter()
        for g, x in w.items():
            for j in at[g]:
                both[j] += min(x, weights[j][g])
            at[g].append(i)
        links += [(i, j) for j, x in both.items() if x / (total[i] + total[j] - x) >= least]
    first = {}
    for i, t in enumerate(texts):
        if (j := first.setdefault(t or "", i)) != i:
            links.append((i, j))
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


def groups_around_the_bar(n, first, words=60, groups=60):
    rng, rows = np.random.default_rng(first), []
    for g in range(groups):  # groups of 2 to 9 texts with some words changed
        base = prose(first + g, words).split()
        for _ in range(2 + g % 8):
            text = list(base)
            for at in rng.choice(words, int(rng.integers(0, 3)), replace=False):
                text[at] = "w" + str(rng.integers(1 << 30))
            rows.append((n + len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_classes_against_all_pairs(spark, least):
    """Over 1000 documents, so that shingles of two or three documents have other weights than those of one."""
    rows = [(i, prose(5000 + i, 60)) for i in range(1200)]
    rows += groups_around_the_bar(len(rows), 9000) + [(8000 + i, prose(77, 60)) for i in range(20)] + [(9000 + i, prose(78, 300) + f" tail{i}") for i in range(30)]
    want, links = brute_classes([t for _, t in rows], least)
    place = {i: k for k, (i, _) in enumerate(rows)}
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()}
    assert len(got) == len(rows) and all(want[place[c]] == want[place[i]] for i, c in got.items())  # nothing joined below the bar
    joined = [got[rows[i][0]] == got[rows[j][0]] for i, j in links]
    assert np.mean(joined) > 0.97 and len(links) > 100


def test_weights_are_exact(spark):
    rows = [(i, prose(5000 + i, 60)) for i in range(300)] + groups_around_the_bar(300, 9000, groups=30) + [(7000 + i, prose(77, 60)) for i in range(9)]
    words = [t.split() for _, t in rows]
    grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in words]
    held = collections.Counter(g for c in grams for g in c)
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(5).withColumn("digest", F.unhex(F.md5("text")))
    signed, n = near_dup.sign(docs)
    assert n == len(rows)
    whole = {bytes(r.digest): r for r in signed.collect() if r.signature is not None}
    for (_, t), c in zip(rows, grams, strict=True):
        r = whole[hashlib.md5(t.encode()).digest()]
        assert sorted(blocks.unpack(r.df, len(c), np.uint32).tolist()) == sorted(held[g] for g in c)
        assert abs(r.weight - sum(x * (1 + np.log(n / held[g]) / np.log(n + 1)) for g, x in c.items())) < 1e-3 * r.weight


def test_samples_agree_as_often_as_the_similarity():
    """Shares of equal samples against weighted Jaccard similarity: 400 samples, so three standard deviations are at most 0.075."""
    rng, tables = np.random.default_rng(4), near_dup._samples()
    for share in (0.2, 0.5, 0.8):
        n = 400
        h = np.sort(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        wa, wb = rng.gamma(2, 3, 2 * n).astype(np.float32), rng.gamma(2, 3, 2 * n).astype(np.float32)
        wb = np.where(rng.random(2 * n) < share, wa, wb).astype(np.float32)
        ka, kb = rng.random(2 * n) < 0.5 + share / 2, rng.random(2 * n) < 0.5 + share / 2
        s = [near_dup.signatures_of(h[k], np.zeros(int(k.sum()), np.int64), w[k], 1, tables, 400)[0] for k, w in ((ka, wa), (kb, wb))]
        true = near_dup.weighted_jaccard((h[ka], wa[ka]), (h[kb], wb[kb]))
        assert abs(np.mean(s[0] == s[1]) - true) < 0.075, (share, true)


def test_bands_meet_at_the_bar():
    assert near_dup.banding(0.8) == (10, 4)
    for least in (0.3, 0.5, 0.7, 0.9, 0.95):
        bands, rows = near_dup.banding(least)
        assert bands * rows <= 40 and 1 - (1 - least**rows) ** bands >= 0.99


def test_components_of_a_bucket_are_joined():
    """A hub that is like none of its bucket, and members that are like each other: links join what similarity joins, with and without blocks."""
    rng, words = np.random.default_rng(9), prose(1, 60).split()
    texts = [prose(500, 60)] + [" ".join(str(w) if rng.random() > 0.02 else f"x{i}{j}" for j, w in enumerate(words)) for i in range(12)] + [prose(600 + i, 60) for i in range(3)]
    n, column = 100, pa.array(texts)
    (_, _, h, doc, times), = near_dup.vectors(column)
    df = np.ones(len(h), np.uint32)
    sig = near_dup.signatures_of(h, doc, near_dup.weigh(n, times, df), len(texts), near_dup._samples(), 40)
    sig[:, :4] = 7  # the bucket of band 0
    cut, names = np.searchsorted(doc, np.arange(len(texts) + 1)), [bytes([i]) * 16 for i in range(len(texts))]
    vector = [(h[a:b], near_dup.weigh(n, times[a:b], df[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if near_dup.weighted_jaccard(vector[i], vector[j]) >= 0.8]

    def classes(links):
        root = list(range(len(texts)))
        for i, j in links:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        return root

    packed = [blocks.pack(df[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    whole = pa.table({"key": [7] * 16, "band": [0] * 16, "lo": [0] * 16, "hi": [0] * 16, "blk": [0] * 16, "digest": names, "class": names, "weight": [float(w.sum()) for _, w in vector], "signature": [s.tobytes() for s in sig]})
    likely = near_dup._likely(10, 4, 0.8)(whole)
    kept = [names.index(x) for x in likely.column("digest").to_pylist()]
    assert 0 not in kept and {i for p in similar for i in p} <= set(kept)
    likely = likely.append_column("text", column.take(pa.array(kept))).append_column("df", pa.array([packed[i] for i in kept]))
    got = [(names.index(r["a"]), names.index(r["b"])) for r in near_dup._joining(10, 4, 0.8, n)(likely).to_pylist()]
    assert classes(got) == classes(similar) and len(got) == len(texts) - len(set(classes(similar))) >= 5
    side = pa.array([i % 2 for i in kept])
    halves = []
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        some = likely.set_column(4, "blk", side).set_column(2, "lo", pa.array([lo] * len(kept))).set_column(3, "hi", pa.array([hi] * len(kept)))
        some = some.filter(pa.array([x.as_py() in (lo, hi) for x in side]))
        halves += [(names.index(r["a"]), names.index(r["b"])) for r in near_dup._joining(10, 4, 0.8, n)(some).to_pylist()]
    assert classes(halves) == classes(similar)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {x: x for p in links for x in p}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    df = spark.createDataFrame([(a.to_bytes(4), b.to_bytes(4)) for a, b in links], "a binary, b binary")
    got = {int.from_bytes(r.node): int.from_bytes(r["class"]) for r in near_dup.components(df).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_hot_keys_are_joined_in_several_tasks(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k long, v long")
    small = big.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = {(r.k, r.v): r.top for r in big.join(small.drop("n"), "k", "left").collect()}
    for how, n in (("left", 901), ("inner", 900)):
        out = common.join_unique(big, small, "k", "n", ["v"], how, most=50)
        rows = out.collect()
        assert out.columns == ["k", "v", "top"] and len(rows) == n and all(want[r.k, r.v] == r.top for r in rows)


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_blocks_hold_all_rows(spark, most):
    rows = [(i, prose(i, i % 50), [i, i + 1], {"a": i}) for i in range(300)] + [(None, None, None, None), (1, "x" * 5000, [], {})]
    df = spark.createDataFrame(rows, "i long, t string, a array<long>, m map<string, int>").repartition(3)
    cut = blocks.to_blocks(common.materialise(df, "x"), "blocks", most).collect()
    assert len({b.block for b in cut}) == len(cut) and sum(b.n for b in cut) == len(rows)
    every = [r for b in cut for r in blocks.thaw(b.data).to_pylist()]
    assert sorted((r["i"] or -1, r["t"] or "") for r in every) == sorted((r[0] or -1, r[1] or "") for r in rows)
    if most == 300:
        assert all(b.n == 1 or b.bytes <= 300 for b in cut)


def test_line_keys_of_more_documents(spark):
    """Lines of at least ``min_docs`` documents, repeated rows of an id counting once; against counting."""
    rng = np.random.default_rng(5)
    lines = [f"a line of text number {i}" for i in range(40)]
    rows = [(int(rng.integers(0, 60)), "\n".join(rng.choice(lines, int(rng.integers(1, 6))))) for _ in range(120)] + [(None, lines[0]), (3, None)]
    for least in (1, 2, 3, 5):
        holders = collections.defaultdict(set)
        for i, t in rows:
            for x in (t or "").split("\n"):
                holders[x].add(1 << 62 if i is None else i)
        want = collections.Counter()
        for i, t in rows:
            own = 1 << 62 if i is None else i
            want[i, t, "\n".join(x for x in (t or "").split("\n") if len(x) < 10 or len(holders[x]) < least or own == min(holders[x]))] += 1
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("given", F.col("text"))
        got = collections.Counter((r.doc_id, r.given, r.text) for r in line_dedup.dedup_lines(df, min_docs=least).collect())
        assert got == want
