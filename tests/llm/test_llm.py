"""Training-data operators against brute force, and on empty, null, repeated and clashing rows."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from aeroquilt.llm import decontaminate, licenses, line_dedup, lm_score, near_dup, packing, pii, quality, tokens, warc
from aeroquilt.llm.textnum import shingles, word_hashes, buffers

WORDS = "the and attion thane dble anea erin her mont elle uxtion der ein ung heit que los cion mente para".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.choice(list("abcdefgh"))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "é" * 30), (5, "é" * 30), (6, "a b c d"), (None, "no id here at all, is there"), (7, "w " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 9, "z") for i, t in ODD], "doc_id long, text string, lang string, n_lines int, kept string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_every_operator_takes_empty_tables(spark, empty):
    assert quality.quality(empty.drop("kept")).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert tokens.count_tokens(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert lm_score.cross_entropy_difference(empty, empty.select("doc_id")).count() == 0
    bench = spark.createDataFrame([(1, prose(1)), (2, None)], "item_id long, text string")
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(empty, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(empty, bench).count() == 0
    assert licenses.scan_licences(empty.selectExpr("text as path", "text")).count() == 0
    assert warc.resolve_revisits(empty.selectExpr("doc_id as page_id", "lang as url", "text as html")).count() == 0


def test_line_dedup_against_sql(spark):
    rows = [(3, "Shared line here\nown three\n  SHARED LINE HERE "), (1, "own one\nshared line here\nshared line here"), (2, None), (4, "short\nshort"), (5, "ÉCOLE longue ligne\nécole longue ligne"), (6, "École Longue Ligne\nx")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_dedup.OP6_SQL})").fetchall()}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.h) for r in got.collect()} == want
    assert want[3][1] == 2 and want[1][1] == 0


def test_line_dedup_odd_rows(odd):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert got[1].n_lines == got[2].n_lines == 1 and got[5].n_dropped == 0 and got[3].n_lines == 2
    assert got[1].kept == "z"


def brute_signals(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def test_quality_signals_against_brute_force(spark):
    texts = [t for _, t in ODD] + ["a b c d e f a b c d e g a b c d e", "x\nx\n\n\ny $5 & <b>", prose(3) + " " + prose(3), "a a a a a a a"]
    got = quality.with_signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_signals(t), t


def test_quality_keeps_prose_and_rejects_junk(spark):
    clean = [(i, ". ".join(prose(100 * i + k, 9) for k in range(12)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join(w + "%&$"[i % 3] * 3 for w in prose(i).split())) for i in range(10)] + [(200 + i, " ".join(w.upper() + "!!" for w in prose(i).split())) for i in range(10)]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(clean + junk, "doc_id long, text string")).where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_best_fit_bins():
    b = packing.BestFit(10, 2)
    assert [b.place(x) for x in (6, 5, 4, 7, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 5)]
    b = packing.BestFit(10, 1)
    assert [b.place(x)[0] for x in (6, 6, 4)] == [0, 1, 1]


def test_packing_covers_every_token(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(odd, capacity=64, open_bins=4).toPandas()
    g = got.sort_values(["sequence_id", "offset"])
    for _, s in g.groupby("sequence_id"):
        assert s.length.sum() <= 64 and list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    for i, text in ODD:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id.isna() if i is None else got.doc_id == i]
        assert {(r.start, r.length, r.ids_crc32) for r in mine.itertuples()} == {(a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for a in range(0, len(ids), 64)}


def brute_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_regular_expressions():
    rng = np.random.default_rng(4)
    alphabet = list("0123456789012345 -.@ab.()+\n1é4")
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 50)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"word{i} please call the helpdesk extension at +1 (555) 123-{4000 + i} thanks") for i in range(40)]
    rows += [(100 + i, f"hm {i} call the helpdesk extension at 55-{7000 + i} thanks") for i in range(5)] + [(200, None), (201, "see 55 of 7001")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:36:43" and got[100].base == "" and got[0].spans == got[0].base and got[200].spans == got[201].spans == ""
    assert got[100].n_spans == 1 and got[200].n_spans == 0


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v, unknown = tokens.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(v, unknown, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = sorted(r.n_tokens for r in tokens.count_tokens(odd).collect())
    assert got == sorted(len(t.encode(x or "").ids) for _, x in ODD)
    rng = np.random.default_rng(5)
    for _ in range(60):  # small vocabularies: many ties
        pieces = {"".join(rng.choice(list("abc▁"), rng.integers(1, 5))) for _ in range(14)}
        v = [("<unk>", 0.0), *[(p, -float(rng.integers(1, 5))) for p in sorted(pieces)]]
        t, c = Tokenizer(models.Unigram(v, 0, False)), tokens.ViterbiCounter(v, 0)
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        for _ in range(10):
            x = "".join(rng.choice(list("abcd "), rng.integers(0, 12)))
            assert c.counts([x.encode()])[0] == len(t.encode(x).ids), (x, v)


def test_near_duplicates(spark):
    base = prose(7, 200).split()
    edited = base[:100] + ["other"] + base[101:]
    chain = base[:50] + ["some"] + base[51:]
    rows = [(10, " ".join(base)), (3, " ".join(base)), (5, " ".join(edited)), (6, " ".join(chain)), (7, prose(8, 200)), (8, None), (9, ""), (11, "one two"), (11, "one two"), (12, "one  two")]
    rows += [(100 + i, prose(7, 30) + " " + prose(50 + i, 200)) for i in range(30)]
    rows += [(400, prose(400, 90)), (400, prose(401, 90)), (401, prose(401, 90)), (None, prose(400, 90)), (None, prose(402, 90))]
    every = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(every) == len({(i, t or "") for i, t in rows}) and sum(r.stays for r in every) == len(every) - 7
    got = {r.doc_id: r.class_id for r in every}
    assert [got[i] for i in (10, 3, 5, 6, 7, 8, 9, 11, 12)] == [3, 3, 3, 3, 7, 8, 8, 11, 11]
    assert sorted((r.class_id, r.stays) for r in every if r.doc_id == 400) == [(400, True)] * 2 and got[401] == 400  # two texts of one id
    assert sorted((r.class_id or -1, r.stays) for r in every if r.doc_id is None) == [(-1, True), (400, False)]
    assert all(got[100 + i] == 100 + i for i in range(30))


def test_shingles_stay_inside_documents():
    data, off = buffers(pa.array(["a b c d e f", "", "A  b\tc d e f", "a b", None]))
    h, doc = shingles(*word_hashes(data, off))
    assert list(doc) == [0, 0, 2, 2, 3] and list(h[:2]) == list(h[2:4]) and len(set(h)) == 3


def test_leaks_are_found_and_short_quotes_are_not(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(20)]
    text = dict(items)
    w = text[3].split()
    rows = [(1, prose(1) + " " + text[0].upper() + "! " + prose(2)), (2, prose(3) + " " + " ".join([*w[:7], "zzzz", *w[8:]])), (3, prose(4) + " " + " ".join(text[5].split()[:5]) + " " + prose(5)), (4, None), (5, ""), (6, prose(6))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, "short"), (98, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 0), (2, 3)}
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_chars=500).collect()}


def test_banded_distance_against_full_table():
    rng = np.random.default_rng(6)
    for _ in range(300):
        r = "".join(rng.choice(list("abc"), rng.integers(5, 20)))
        t = list(r)
        for _ in range(rng.integers(0, 4)):
            t.insert(int(rng.integers(0, len(t) + 1)), str(rng.choice(list("abc"))))
            t.pop(int(rng.integers(0, len(t))))
        t, e = "z" + "".join(t) + "zz", int(rng.integers(1, 5))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(r, 1):
            new = [i, *[0] * len(t)]
            for j, x in enumerate(t, 1):
                new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
            row = new
        assert min(decontaminate.banded_distance(r, t, e), e + 1) == min(min(row), e + 1)


def test_licences_and_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "int main"), ("a/b/c/y.c", "// Licensed under the Apache License,\n// Version 2.0"), ("a/b/c/z.c", None), ("q/r.c", ""), (None, "Released under the MIT License."), ("top.txt", "x"), ("a/b/x.c", "int main")]
    got = {r.path: (r.licence, r.origin, r.declared_in) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/b/x.c": ("MIT", "inherited", "a"), "a/b/c/y.c": ("Apache-2.0", "own", None), "a/b/c/z.c": ("Apache-2.0", "inherited", "a/b/c"), "q/r.c": (None, None, None), "top.txt": (None, None, None), None: (None, None, None)}


@pytest.mark.parametrize("frequent", [4_000_000, 20])
def test_lm_scores_against_counting(spark, frequent, monkeypatch):
    import collections
    import math

    texts = ["Hello world", "hello there world é", "", None, "abc abc abc abc", "zzz"] * 2 + ["Hello hello hello"]
    target = [1, 0, 0, 0, 1, 0] * 2 + [0]
    n, low = 5, lambda t: bytes(4) + (t or "").encode().translate(bytes(lm_score._LOWER))
    want = {}
    for m in "bt":
        c = {5: collections.Counter(x[i : i + n] for t, y in zip(texts, target, strict=True) if m == "b" or y for x in [low(t)] for i in range(len(x) - 4))}
        for k in range(4, 0, -1):
            c[k] = collections.Counter()
            for g, v in c[k + 1].items():
                c[k][g[1:]] += v
        total, kinds = {k: collections.Counter() for k in c}, {k: collections.Counter() for k in c}
        for k in c:
            for g, v in c[k].items():
                total[k][g[:-1]] += v
                kinds[k][g[:-1]] += 1

        def p(g, c=c, total=total, kinds=kinds):
            if len(g) == 1:
                return (c[1][g] + 1) / (sum(c[1].values()) + 256)
            k, h, q = len(g), g[:-1], p(g[1:])
            return (c[k][g] + kinds[k][h] * q) / (total[k][h] + kinds[k][h]) if total[k][h] else q

        for i, t in enumerate(texts):
            x = low(t)
            want[i, m] = [-math.log(p(x[j : j + n])) for j in range(len(x) - 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i, y in enumerate(target) if y] + [(999,)], "doc_id long")
    counts = lm_score.count_grams(df.join(ids.withColumn("y", F.lit(True)), "doc_id", "left"), "text", "y")
    for r in lm_score.score(df, lm_score.fit(counts), frequent=frequent).collect():
        if not r.n_tokens:
            assert r.score is None
        else:
            assert abs(r.loss_target - np.mean(want[r.doc_id, "t"])) < 1e-5 and abs(r.loss_background - np.mean(want[r.doc_id, "b"])) < 1e-5
    if frequent == 20:
        whole = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(df, ids).collect()}
        assert whole[2] is None and whole[0] < whole[5]
