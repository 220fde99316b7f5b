"""Licences, decontamination, personal data, quality rules and long texts against brute force."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from aeroquilt.llm import decontaminate, licenses, line_dedup, lm_score, near_dup, packing, pii, quality, tokens
from tests.llm.test_llm import prose


def test_credentials_are_seeds_and_their_context_finds_others(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'word{i} token = "{key(i)}" w{i}') for i in range(12)] + [(50, f'x token = "{key(50).upper()}" y'), (51, f"commit {key(51)} y"), (52, 'x token = "few" y')] * 2
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].spans == "secret:15:55" and got[0].n_spans == 1 and got[0].base == ""
    assert got[50].spans == "secret:11:51" and got[51].spans == got[52].spans == ""


def brute_bootstrap(edges, support=5.0, sure=0.8):
    """The rounds of ``bootstrap`` over a list of (pattern, instance, kind)."""
    touches, seeds = collections.defaultdict(set), {}
    for p, i, k in edges:
        touches[p].add(i)
        if k >= 0:
            seeds.setdefault(i, {})[k] = 1.0
    found = {}
    while True:
        known = {**seeds, **found}
        accepted = {}
        for p, ins in touches.items():
            for k in range(5):
                positive = sum(known[i][k] for i in ins if k in known.get(i, {}))
                if positive >= support and positive / len(ins) >= sure:
                    accepted[p, k] = positive / len(ins)
        score = collections.defaultdict(lambda: 1.0)
        for p, i, k in edges:
            if k < 0:
                for kind in range(5):
                    if (p, kind) in accepted:
                        score[i, kind] *= 1 - min(accepted[p, kind], 0.99)
        new = {}
        for (i, k), s in sorted(score.items()):
            s = round(1 - s, 6)
            if s >= sure and i not in seeds:
                new.setdefault(i, {})[k] = s
        if new == found:
            return {i: max(((k, s) for k, s in of.items()), key=lambda x: (x[1], -x[0])) for i, of in found.items()}
        found = new


def test_bootstrap_against_brute_force(spark):
    """Chains of patterns that only found instances reach, and patterns that several kinds share."""
    rng, edges = np.random.default_rng(12), set()
    for kind in range(3):
        at = 10_000 * kind
        seed, first, second, third = (list(range(at + a, at + b)) for a, b in ((0, 20), (100, 104), (200, 203), (300, 302)))
        for step, touched in enumerate([seed + first, seed + first + second, seed[:8] + first + second + third, seed[:3] + third + list(range(at + 400, at + 420))]):
            edges |= {(100 * kind + step, i, kind if i in seed else -1) for i in touched}
        edges |= {(800, i, kind if i in seed else -1) for i in seed[:5] + third}  # a pattern of all kinds
    for _ in range(60):
        edges.add((int(rng.integers(900, 903)), 10_000 * int(rng.integers(0, 3)) + int(rng.integers(0, 5000)), -1))
    seeded = {i: k for _, i, k in edges if k >= 0}
    edges = {(p, i, seeded.get(i, k)) for p, i, k in edges}
    want = brute_bootstrap(sorted(edges))
    got = {r.instance: (r.kind, r.score) for r in pii.bootstrap(spark.createDataFrame(sorted(edges), "pattern long, instance long, kind int")).collect()}
    assert len(want) >= 27 and got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)


def test_least_edits_are_those_of_the_best_place(spark):
    item = prose(1500, 30)
    words = item.split()
    edited = " ".join([*words[:9], "zzzz", *words[10:]])
    docs = spark.createDataFrame([(1, f"{prose(1)} {edited} {prose(2)} {item} {prose(3)}"), (2, f"{prose(4)} {edited}"), (3, item), (3, edited), (4, prose(5))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "a very short item"), (9, "q w e")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {1, 2, 3} and got[1].least_edits == got[3].least_edits == 0 and got[1].n_regions == len(decontaminate.regions(len(decontaminate.normalise(item))))
    assert [r.text for r in decontaminate.without_leaks(docs, bench).collect()] == [prose(5)]
    short = spark.createDataFrame([(1, "so: A very SHORT item!"), (2, "a very short items"), (3, "xa very short item")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(short, bench).collect()] == [(1, 8)]


def brute_leaks(text, item):
    """Whether any region of the item is within its edits of a substring of the text, by the full table."""
    t = decontaminate.normalise(text)
    for a, b in decontaminate.regions(len(item)):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(item[a:b], 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
            row = new
        if min(row) <= int(decontaminate.RATE * (b - a)):
            return True
    return False


def test_leaks_against_full_tables(spark):
    rng, rows, want = np.random.default_rng(11), [], set()
    items = [(i, decontaminate.normalise(prose(1000 + i, 18 + 4 * i))) for i in range(5)]
    for d in range(40):
        _, text = items[d % 5]
        a = int(rng.integers(0, max(1, len(text) - 100)))
        part = list(text[a : a + int(rng.integers(50, 130))])
        for _ in range(int(rng.integers(0, 12))):
            at = int(rng.integers(0, len(part)))
            part[at] = str(rng.choice(["", "q", part[at] + "z"]))
        rows.append((d, f"{prose(3000 + d, 4)} {''.join(part)} {prose(4000 + d, 4)}"))
        want |= {(d, k) for k, x in items if brute_leaks(rows[-1][1], x)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 5 < len(want) < 38


@pytest.mark.parametrize("size", [91, 140])
def test_verbatim_quotes_are_found_wherever_they_begin(size):
    item = decontaminate.normalise(prose(1700, 70))
    ix = decontaminate.Index([(1, item)])
    rows = [f"{prose(a, 9)} {item[a : a + size]} {prose(a + 1, 9)}" for a in range(len(item) - size + 1)]
    assert {r for r, *_ in ix.search(pa.array(rows))} == set(range(len(rows)))


def test_licence_headers_files_and_sentences(spark):
    import textwrap

    long = dict(licenses.LONG)
    wrap = lambda t, lead: "\n".join(lead + x for x in textwrap.wrap(t, 70))
    rows = [
        ("a/x.c", "/*\n" + wrap("Copyright (C) 2020 Some Body. " + long["GPL-3.0"], " * ") + "\n */\nint main() {}"), ("b/LICENSE", "Copyright (c) 2001, Foo\n\n" + wrap(long["BSD-3-Clause"], "")),
        ("c/COPYING", "   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Everyone is permitted to copy\n\n Preamble"),
        ("d/y.txt", "This work is licensed under the GNU General Public License, version 3. Then came another story with many words that follow on the line."),
        ("e/LICENSE.txt", "  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n TERMS"), ("f/z.py", "# Some file\n# Licensed under the Apache License,\n# Version 2.0.\nimport x"), ("g/w.py", wrap(long["MIT"], "# ")),
        ("h/p.txt", "the general version of the licensed program is free for any of the public"),
    ]
    got = {r.path: r.licence for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x.c": "GPL-3.0", "b/LICENSE": "BSD-3-Clause", "c/COPYING": "GPL-3.0", "d/y.txt": "GPL-3.0", "e/LICENSE.txt": "Apache-2.0", "f/z.py": "Apache-2.0", "g/w.py": "MIT", "h/p.txt": None}


def brute_licences(rows, least=0.7):
    """Best template of every line, window, sentence, comment block, paragraph and file, by dictionaries, without cues."""
    n, split = len(rows), licenses._split
    held = collections.Counter(w for _, t in rows for w in set(split(t or "")))
    known = {w for _, t in licenses.TEMPLATES for w in split(t)}
    idf = lambda w: np.log((1 + n) / (1 + (held[w] if w in known else 0))) + 1

    def unit(t):
        w = {x: k * idf(x) for x, k in collections.Counter(split(t)).items()}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {x: v / size for x, v in w.items()}

    units, out = [(lic, unit(t)) for lic, t in licenses.TEMPLATES], {}
    for path, text in rows:
        lines, parts = (text or "").split("\n"), []
        marks = [bool(re.match(licenses.COMMENT, x)) for x in lines]
        for i, line in enumerate(lines):
            parts += [line, *re.split(r"(?<=[.!?;:])\s+", line)]
            parts += [" ".join(lines[max(0, i + a) : max(0, i + a + k)]) for a, k in ((0, 2), (0, 3), (-1, 2), (-1, 3), (-2, 3))]
            if marks[i] and not (i and marks[i - 1]):
                j = i
                while j < len(lines) and marks[j]:
                    j += 1
                parts.append(" ".join(lines[i:j]))
        if re.search(licenses.LICENCE_FILE, path):
            parts += [text or "", *re.split(r"\n\s*\n", text or "")]
        for p in parts:
            u = unit(p) if split(p) else {}
            for lic, v in units:
                s = round(sum(x * v.get(w, 0.0) for w, x in u.items()), 9)
                if s >= least and (path not in out or (-s, lic) < (-out[path][1], out[path][0])):
                    out[path] = (lic, s)
    return out


def test_licences_against_brute_force(spark):
    rng, rows = np.random.default_rng(7), []
    filler = "the a of program version general public license source form free work under software any is by and mit cc commons file".split()
    for i in range(150):
        lines = [" ".join(rng.choice(filler, int(rng.integers(0, 9)))) for _ in range(int(rng.integers(0, 5)))]
        if rng.random() < 0.7:
            _, t = licenses.TEMPLATES[int(rng.integers(0, len(licenses.TEMPLATES)))]
            words = [w for w in t.split() if rng.random() < 0.9]
            cut = sorted(rng.integers(0, len(words) + 1, int(rng.integers(0, 3))).tolist())
            lead = str(rng.choice(["", "# ", "// ", " * "]))
            at = int(rng.integers(0, len(lines) + 1))
            lines[at:at] = [lead + " ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)], strict=True)]
        rows.append((f"d{i % 7}/{i}/" + str(rng.choice(["x.c", "LICENSE", "COPYING.txt", "notice"])), "\n".join(lines)))
    want = brute_licences(rows)
    got = {r.path: (r.licence, r.score) for r in licenses.own_licences(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect()}
    long = {lic for lic, _ in licenses.LONG}
    lost = {p for p in want if p not in got or got[p][1] < want[p][1] - 1e-6}
    assert all(p in want and (p in lost or (abs(got[p][1] - want[p][1]) < 1e-6 and got[p][0] == want[p][0])) for p in got)
    assert all(want[p][0] in long for p in lost) and len(lost) <= 0.05 * len(want) and len(want) > 60  # fragments of long texts without a cue


def test_cue_terms_lose_nothing():
    idf = {w: 1.0 + len(w) % 4 for _, t in licenses.TEMPLATES for w in licenses._split(t)}
    units = licenses.vectors(licenses.NOTICES + licenses.TITLES, idf)
    cues = set(licenses.cue_terms(units, 0.7))
    for _, _, unit in units:
        assert sum(x * x for t, x in unit.items() if t not in cues) < 0.49
    assert all(cues & set(licenses._split(t)) for _, t in licenses.LONG)


def test_expectation_maximisation_against_brute_force(spark):
    """The model of ``fit`` against rounds over single rows, and the accuracies it finds against those planted."""
    rng, n = np.random.default_rng(13), 4000
    good = rng.random(n) < 0.8
    votes = np.zeros((n, len(quality.VOTES)), np.int64)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75]
    for k, p in enumerate(right):
        fires = rng.random(n) < 0.6
        votes[:, k] = np.where(fires, np.where(rng.random(n) < p, 1, -1) * np.where(good, 1, -1), 0)
    model = quality.fit(spark.createDataFrame(pd.DataFrame(votes, columns=quality.VOTES).assign(vote_of_the_table=1)))
    prior, probs = quality.START["prior"], {y: np.tile(quality.START[y], (len(right), 1)) for y in ("good", "bad")}
    for _ in range(40):
        odds = np.log(prior / (1 - prior)) + sum(np.log(probs["good"][k][votes[:, k] + 1] / probs["bad"][k][votes[:, k] + 1]) for k in range(len(right)))
        p = 1 / (1 + np.exp(-odds))
        new = {y: np.array([[((w * (votes[:, k] == v)).sum() + 10 * quality.START[y][v + 1]) / (w.sum() + 10) for v in (-1, 0, 1)] for k in range(len(right))]) for y, w in (("good", p), ("bad", 1 - p))}
        moved = max(np.abs(new[y] - probs[y]).max() for y in new)
        prior, probs = min(0.99, max(0.01, p.mean())), new
        if moved < 1e-4:
            break
    assert abs(model["prior"] - prior) < 1e-6
    assert all(np.abs(np.array(model[c][y]) - probs[y][k]).max() < 1e-6 for k, c in enumerate(quality.VOTES) for y in probs)
    found = quality.accuracies(model)
    assert all(abs(found[c.removeprefix("vote_")] - r) < 0.06 for c, r in zip(quality.VOTES, right, strict=True))


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, prose(1, 40) + "."), (1, prose(2, 40) + "."), (2, "%%% $$$")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as kept", "3 as quality", "4 as vote_shouts", "5 as vote_own", "6 as spans", "7 as licence", "8 as length")
    out = quality.quality(df).collect()
    assert sorted((r.doc_id, r.n_words, r.vote_own) for r in out) == [(1, 40, 5), (1, 40, 5), (2, 2, 5)]
    assert len(pii.find_personal_data(df).collect()) == 3 and len(tokens.count_tokens(df).collect()) == 3 and len(packing.pack_documents(df).collect()) == 3
    assert len(lm_score.cross_entropy_difference(df, df.select("doc_id")).collect()) == 3
    assert [r.licence for r in licenses.scan_licences(df.withColumn("path", F.col("doc_id").cast("string"))).collect()] == [None, None]


def test_a_very_long_text(spark):
    item, line = prose(900, 30), "A line that another document holds."
    text = "\n".join(prose(i, 200) + "." for i in range(1500)) + f"\n{line}\n{item} mail a.b@c.de"
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, f"{line}\nx"), (2, text), (3, text + " more words at the end")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 2}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 1501}
    assert {r.doc_id for r in decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {2, 3}
    assert {r.doc_id: r.n_email for r in pii.find_personal_data(df).collect()} == {1: 0, 2: 1, 3: 1}
    pieces = packing.pack_documents(df).where("doc_id = 2").toPandas()
    assert pieces.length.max() == 4096 and len(pieces) == -(-pieces.length.sum() // 4096)
