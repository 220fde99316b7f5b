"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1.  Weights.  A shingle weighs its count in the document times 1 + log(N / df) / log(N + 1), df being the exact number of documents that hold it: from 1
    for a shingle of all documents to about 2 for one of a single document, so that in a large group of copies a few edits do not outweigh all that is shared.
    Blocks of documents ask ranges of hashes how many documents hold each of their shingles (``blocks.exchange``), so a
    shingle that a third of all documents hold costs one question for each block, and no list of frequent shingles is needed.
2.  Signatures.  Each document's weighted shingles give ``bands * rows`` consistent weighted samples.  Exact copies (by 128-bit digest of
    the text) collapse to one representative.
3.  Links.  In each band bucket all members are linked to the one of the least digest, and links are verified by exact weighted Jaccard
    similarity, in tasks of bounded size.  Buckets that then still hold several components are searched again in blocks of bounded size: first by
    signatures alone, which leaves the members that agree with one of another component on enough samples; then these meet with their texts, and
    components are joined inside the task, so that a pair within a joined component is not looked at.  No bucket emits its pairs, and none is capped.
4.  Classes are connected components by alternating large-star and small-star steps.

Pairs at the bar meet in a band with probability 0.99 or more (``banding``).  Two bounds skip pairs: total weights that differ by more than the bar
cannot reach it, which is exact; and pairs across components must agree on all but three standard deviations of the samples expected at the bar.

Defined cases: equal texts share a class, empty and null ones too; a document without words has no other near duplicates; one with fewer
than five words has one shingle of all of them; an id with several texts is several documents, each with its own row; equal rows count
as documents in the frequencies and give one row; a null id comes after all others when a class is named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import exchange, pack, range_count, to_blocks, unpack, with_answers
from .common import forget, join_unique, materialise, table
from .textnum import buffers, chunks, distinct, mix, shingles, word_hashes

SIMILAR = 0.8
SAMPLES = 40
BLOCK = 1024  # members of a bucket compared with each other in one task, or with as many others
BLOCK_SHINGLES = 1 << 21  # and at most about so many shingles
LEADS = 512  # texts compared with one representative in one task
TASK_PAIRS = 2000
LAST_ID = (1 << 63) - 1
_TABLE_BITS = 16


def banding(least: float, samples: int = SAMPLES, recall: float = 0.99) -> tuple[int, int]:
    """(bands, rows): the longest rows with which a pair of similarity ``least`` meets in a band with probability ``recall``."""
    rows = 1
    while samples // (rows + 1) and 1 - (1 - least ** (rows + 1)) ** (samples // (rows + 1)) >= recall:
        rows += 1
    return samples // rows, rows


def _samples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws of r ~ Gamma(2, 1), log c with c ~ Gamma(2, 1), and beta ~ U(0, 1), each picked by 16 bits of its own."""
    rng = np.random.default_rng(20240229)
    n = 1 << _TABLE_BITS
    return rng.gamma(2, 1, n).astype(np.float32), np.log(rng.gamma(2, 1, n)).astype(np.float32), rng.random(n, np.float32)


def vectors(column, k: int = 5, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, hash, document, times) of ranges of rows: distinct shingles by document, sorted by hash inside it."""
    data, off = buffers(column)
    for i, j in chunks(off, most):
        words, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, *distinct(*shingles(words, at, k))


def weigh(n: int, times: np.ndarray, df: np.ndarray) -> np.ndarray:
    """TF-IDF weight of shingles that ``df`` of ``n`` documents hold."""
    return (1 + np.log(n / df) / np.log(n + 1)).astype(np.float32) * times.astype(np.float32)


def asker(k: int = 5):
    """Shingles of a block with the number of its documents that hold each; with ``state``, its vectors and the place of their shingles too."""

    def ask(rows: pa.Table, state: bool = False):
        found = list(vectors(rows.column("text"), k))
        every = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint64)
        if not len(every):
            return (every, (found, every, every)) if state else (every, [np.zeros(0, np.uint32)])
        order = np.argsort(every) if state else None
        ordered = every[order] if state else np.sort(every)
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        first = np.flatnonzero(new)
        held = np.diff(np.append(first, len(every))).astype(np.uint32)
        if not state:
            return ordered[first], [held]
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        return ordered[first], (found, held, place)

    return ask


def total_documents(h: np.ndarray, columns: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each shingle, told to the blocks whose own documents are not all of them."""
    order = np.argsort(h)
    ordered = h[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total = np.empty(len(h), np.uint32)
    total[order] = np.repeat(np.add.reduceat(columns[0][order], first), np.diff(np.append(first, len(h))))
    at = np.flatnonzero(total > columns[0])
    return at, total[at]


def signatures_of(h: np.ndarray, doc: np.ndarray, w: np.ndarray, size: int, tables, samples: int) -> np.ndarray:
    """(documents, samples) of 32-bit fingerprints of (shingle, quantised weight); rows of documents without shingles are 0."""
    r_of, c_of, b_of = tables
    out = np.zeros((size, samples), np.uint32)
    if not len(h):
        return out
    low = np.uint64((1 << _TABLE_BITS) - 1)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    have, place, log_w = doc[starts], np.arange(len(h), dtype=np.uint64), np.log(w)
    for s in range(samples):
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * s + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)  # a hash of shingle and sample number, the same for every document
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xA0761D6478BD642F)
        r, beta = r_of[x >> np.uint64(48)], b_of[x >> np.uint64(32) & low]
        t = np.floor(log_w / r + beta)
        a = c_of[x >> np.uint64(16) & low] - r * (t - beta) - r  # log of the sample's value; the least one wins
        bits = a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)  # ordered as unsigned
        won = (np.minimum.reduceat((bits << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[have, s] = (mix(h[won] ^ (t[won].astype(np.int64).view(np.uint64) * (seed | np.uint64(1)))) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def sign(docs: DataFrame, k: int = 5, samples: int = SAMPLES) -> tuple[DataFrame, int]:
    """``doc, digest, text`` to ``doc, digest, weight, signature, df, shingles``, and the number of rows.

    ``weight``, ``signature`` and ``df`` are null but in one row of each digest in a block, and there too without words; ``df`` is packed, by sorted shingle.
    """
    blocks = to_blocks(docs.select("doc", "digest", "text"), "near-blocks")
    n, ranges, ask = blocks.agg(F.sum("n")).first()[0] or 0, range_count(blocks), asker(k)
    answered = exchange(blocks, lambda rows: ask(rows), [np.uint32], total_documents, np.uint32, ranges, "near-counts")

    def use(rows: pa.Table, state, at: np.ndarray, values: np.ndarray) -> pa.Table:
        tables, (found, df, place), out, done, digests = _samples(), state, [], 0, rows.column("digest").to_pylist()
        first, df = {}, df.copy()
        for i, d in enumerate(digests):
            first.setdefault(d, i)
        once = np.zeros(len(digests), bool)
        once[list(first.values())] = True
        df[at] = values
        for i, j, h, doc, times in found:
            own = df[place[done : done + len(h)]]
            done += len(h)
            some = once[i:j][doc] if len(h) else np.zeros(0, bool)
            h, doc, times, own = h[some], doc[some], times[some], own[some]
            w = weigh(n, times, own)
            total = np.bincount(doc, w, minlength=j - i) if len(h) else np.zeros(j - i)
            s = signatures_of(h, doc, w, j - i, tables, samples)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            have = (total > 0).tolist()
            out.append(pa.table({
                "doc": rows.column("doc").slice(i, j - i), "digest": rows.column("digest").slice(i, j - i), "weight": pa.array([t if y else None for t, y in zip(total.tolist(), have, strict=True)], pa.float64()),
                "signature": pa.array([x.tobytes() if y else None for x, y in zip(s, have, strict=True)], pa.binary()),
                "df": pa.array([pack(own[cut[d] : cut[d + 1]]) if y else None for d, y in enumerate(have)], pa.binary()), "shingles": pa.array(np.diff(cut), pa.int64()),
            }))
        return pa.concat_tables(out)

    signed = with_answers(blocks, answered, ask, use, np.uint32, ranges, "doc long, digest binary, weight double, signature binary, df binary, shingles long")
    signed = materialise(signed, "near-signed")
    forget(blocks, answered)
    return signed, n


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights)."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = float(np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64))
    return both / (total - both)


def verify(pairs: DataFrame, texts: DataFrame, n: int, least: float, k: int = 5, leads: int = LEADS) -> DataFrame:
    """The distinct pairs (a, b) of digests whose texts reach ``least``; ``texts``: one row per digest (digest, text, df).

    A representative ``a`` goes with at most ``leads`` of its partners at a time, so its text is repeated once for each so many.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(leads)).cast("int").alias("shares"), F.count("*").alias("n"))
    members = join_unique(pairs, shares, "a", "n", ["b"]).select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.col("b").alias("digest"), F.lit(False).alias("lead"))
    heads = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("digest"), F.lit(True).alias("lead"))
    rows = materialise(members.unionByName(heads), "near-compared")
    parts = max(1, rows.count() // TASK_PAIRS)
    given = join_unique(rows, texts.join(rows.groupBy("digest").agg(F.count("*").alias("n")), "digest"), "digest", "n", ["a", "share"], "inner")
    given = given.withColumn("part", F.pmod(F.xxhash64("a", "share"), F.lit(parts)).cast("int")).select("part", "a", "share", "lead", "digest", "text", "df")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("a", "ascending"), ("share", "ascending"), ("lead", "descending")]).combine_chunks()
        a, b, lead, dfs = (group.column(c).to_pylist() for c in ("a", "digest", "lead", "df"))
        head, found = None, []
        for i, j, h, doc, times in vectors(group.column("text"), k):
            cut = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
            for r in range(i, j):
                own = slice(cut[r - i], cut[r - i + 1])
                v = h[own], weigh(n, times[own], unpack(dfs[r], own.stop - own.start, np.uint32))
                if lead[r]:
                    head = v
                elif weighted_jaccard(head, v) >= least:
                    found.append(r)
        return pa.table({"a": pa.array([a[r] for r in found], pa.binary()), "b": pa.array([b[r] for r in found], pa.binary())})

    return given.groupBy("part").applyInArrow(run, "a binary, b binary")


def components(links: DataFrame, name: str = "near-components") -> DataFrame:
    """(node, class) of every linked node but the least of its component: that least one, by alternating large-star and small-star steps.

    A row is two digests.  Both joins end in a shuffle by other columns, so adaptive execution may split the partition of a node with very many links.
    """

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = stamp(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # larger neighbours go to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        after = stamp(new)
        forget(edges)
        edges = new
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
        before = after


def expected_agreement(least: float, samples: int) -> int:
    """Samples on which a pair at the bar agrees, less three standard deviations."""
    return max(1, math.floor(samples * least - 3 * math.sqrt(samples * least * (1 - least))))


def _pairs(group: pa.Table, bands: int, rows: int, least: float) -> np.ndarray:
    """(samples in common, i, j): pairs of the two blocks of a group that may reach the bar, across components.

    A pair that shares several buckets is looked at in the one of its first common band.
    """
    samples, side, weight = bands * rows, group.column("blk").to_numpy(), group.column("weight").to_numpy()
    s = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(side), samples)
    _, comp = np.unique(np.array([x.ljust(17, b".") for x in group.column("class").to_pylist()]), return_inverse=True)
    low, high, band = (group.column(c)[0].as_py() for c in ("lo", "hi", "band"))
    enough, right, found = expected_agreement(least, samples), np.flatnonzero(side == high), [np.zeros((3, 0), np.int64)]
    for i in np.flatnonzero(side == low):
        other = right[right > i] if low == high else right
        other = other[(comp[other] != comp[i]) & (np.minimum(weight[other], weight[i]) >= least * np.maximum(weight[other], weight[i]))]
        same = s[other] == s[i]
        equal = same.sum(axis=1)
        hit = (equal >= enough) & ~same[:, : band * rows].reshape(len(other), band, rows).all(axis=2).any(axis=1)
        found.append(np.stack([equal[hit], np.full(int(hit.sum()), i), other[hit]]))
    return np.concatenate(found, axis=1)


def _likely(bands: int, rows: int, least: float):
    """The rows of a group that are in any of its pairs."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("digest").combine_chunks()
        return group.take(pa.array(np.unique(_pairs(group, bands, rows, least)[1:])))

    return run


def _joining(bands: int, rows: int, least: float, n: int, k: int = 5):
    """Verified links that join the components of a group; ``n``: documents in all.  The similarities of a member with all it may be like are summed at once."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("digest").combine_chunks()
        ids, dfs, found = group.column("digest").to_pylist(), group.column("df").to_pylist(), _pairs(group, bands, rows, least)
        h, doc, w = [], [], []
        for i, j, own, of, times in vectors(group.column("text"), k):
            df = np.concatenate([unpack(dfs[i + d], c, np.uint32) for d, c in enumerate(np.bincount(of, minlength=j - i).tolist()) if c])
            h, doc, w = [*h, own], [*doc, of + i], [*w, weigh(n, times, df)]
        h, doc, w = np.concatenate(h), np.concatenate(doc), np.concatenate(w).astype(np.float64)
        total, cut = np.bincount(doc, w, minlength=len(ids)), np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        count = np.diff(np.append(head, len(h)))
        place = np.empty(len(h), np.int64)
        place[order] = np.repeat(np.arange(len(head)), count)
        doc_of, w_of = doc[order], w[order]
        named = {}
        root = [named.setdefault(c, len(named)) for c in group.column("class").to_pylist()]
        comp, root = root, list(range(len(named)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links, found = [], found[:, np.argsort(found[1], kind="stable")]
        starts = np.flatnonzero(np.r_[True, found[1][1:] != found[1][:-1]]) if found.shape[1] else np.zeros(0, np.int64)
        runs = list(zip(starts.tolist(), np.append(starts[1:], found.shape[1]).tolist(), strict=True))
        for x, y in sorted(runs, key=lambda r: -int(found[0, r[0] : r[1]].max())):  # likeliest members first
            i = int(found[1, x])
            open_yet = [j for j in found[2, x:y][np.argsort(-found[0, x:y], kind="stable")].tolist() if find(comp[j]) != find(comp[i])]
            if not open_yet:
                continue
            mine = place[cut[i] : cut[i + 1]]
            size = count[mine]
            ends = np.cumsum(size)
            at = np.repeat(head[mine] - ends + size, size) + np.arange(int(ends[-1]))
            both = np.bincount(doc_of[at], np.minimum(np.repeat(w[cut[i] : cut[i + 1]], size), w_of[at]), minlength=len(ids))
            for j in open_yet:
                a, b = find(comp[i]), find(comp[j])
                if a != b and both[j] >= least * (total[i] + total[j] - both[j]):
                    root[max(a, b)] = min(a, b)
                    links.append((ids[min(i, j)], ids[max(i, j)]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


def _members(buckets: DataFrame, label: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components: one for each pair of blocks that a member belongs to."""
    named = buckets.join(label, buckets["digest"] == label["node"], "left").withColumn("class", F.coalesce("class", "digest")).drop("node")
    named = named.join(reps.select("digest", "weight", "signature", "shingles"), "digest")
    size = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    split = named.groupBy("key").agg(size.alias("blocks"), F.count("*").alias("n"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1 and n > 2").select("key", "blocks", "n")
    named = join_unique(named, split, "key", "n", ["digest"], "inner")
    named = named.withColumn("blk", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    spread = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("key", "band", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "digest", "class", "weight", "signature")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, k: int = 5, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, digest, class_id, copy_of, stays) of every distinct id and text; ids are integers.

    ``class_id`` is the least id of the class, ``copy_of`` that of the documents with the same text; ``stays`` marks the
    one row of each class that has the least id, and of several such the least digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    bands, rows = banding(least, samples)
    signed, n = sign(given, k, bands * rows)
    one = signed.select("doc", "digest").distinct()
    reps = signed.groupBy("digest").agg(F.min("doc").alias("doc"), F.max(F.struct("signature", "weight", "df", "shingles")).alias("s")).select("digest", "doc", "s.*").where("signature is not null")
    reps = materialise(reps, "near-reps")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("signature"), i * 4 * rows + 1, F.lit(4 * rows))).alias("key")))
    member = reps.select("digest", "weight", F.explode(keys).alias("k")).select("digest", "weight", "k.band", "k.key")
    hubs = member.groupBy("key").agg(F.min(F.struct("digest", "weight")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(join_unique(member, hubs.select("key", F.col("hub.digest").alias("hub"), F.col("hub.weight").alias("hub_weight"), "n"), "key", "n", ["digest"], "inner"), "near-buckets")
    close = F.least("weight", "hub_weight") >= F.lit(least) * F.greatest("weight", "hub_weight")
    pairs = buckets.where((F.col("digest") > F.col("hub")) & close).select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
    pairs = materialise(pairs, "near-pairs")
    wanted = reps.join(buckets.select("digest").distinct(), "digest").select("digest", "doc", "df")
    texts = materialise(given.join(wanted, ["doc", "digest"]).select("digest", "text", "df").dropDuplicates(["digest"]), "near-texts")
    links = materialise(verify(pairs, texts, n, least, k), "near-links")
    buckets, label = buckets.select("key", "band", "digest"), components(links)
    across = _members(buckets, label, reps)  # of buckets with several components left
    likely = across.groupBy("key", "lo", "hi").applyInArrow(_likely(bands, rows, least), across.schema)
    more = likely.join(texts, "digest").groupBy("key", "lo", "hi").applyInArrow(_joining(bands, rows, least, n, k), "a binary, b binary")
    label = components(links.unionByName(materialise(more, "near-more")))
    first = one.groupBy("digest").agg(F.min("doc").alias("copy_of"), F.count("*").alias("n"))
    named = first.join(label, first["digest"] == label["node"], "left").withColumn("class", F.coalesce("class", "digest")).drop("node")
    named = materialise(named, "near-named")
    heads = named.groupBy("class").agg(F.min(F.struct("copy_of", "digest")).alias("head"), F.count("*").alias("size"))
    named = materialise(join_unique(named, heads, "class", "size", ["digest"], "inner"), "near-classes")
    out = join_unique(one, named.select("digest", "copy_of", "n", "head"), "digest", "n", ["doc"], "inner")
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    stays = (F.col("doc") == F.col("head.copy_of")) & (F.col("digest") == F.col("head.digest"))
    return out.select(known("doc").alias("doc_id"), "digest", known("head.copy_of").alias("class_id"), known("copy_of").alias("copy_of"), stays.alias("stays"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")
