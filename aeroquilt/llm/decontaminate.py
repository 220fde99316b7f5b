"""Benchmark decontamination by the q-gram lemma.

The benchmark is the query set; documents never move.  Items are covered by regions of at most ``REGION`` characters that begin every ``STRIDE``.  A
document's hashed character q-grams are looked up among the items'; every hit has a diagonal (document minus item position), and
hits at distinct places of a region are counted in overlapping diagonal bands of width 2 * budget.  A region of m characters within e edits shares at
least m + 1 - q * (e + 1) q-grams with its text, on diagonals that differ by at most e: bands that reach the bound are kept and verified
by banded alignment (edit distance of the region to a substring of the document), many at a time.

So an item is found in a document if any stretch of REGION + STRIDE - 1 of its characters (91, some 15 words) is there as it is, wherever it begins, or if
one of its regions is there with at most a tenth of its characters edited.  Shorter items are one region; those under ``SHORTEST`` characters must be
there word for word.

Both sides are normalised: lower case, letters and digits only, other runs a single space.  Items are read in blocks of a bounded size, so a
large benchmark makes more passes, not a larger broadcast.

Defined cases: null or empty texts match nothing; an item shorter than a q-gram is not searched; repeated items are all reported; rows of one document id are
searched one by one and reported once, with the regions of all and the least edits of any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textnum import buffers, chunks, mix

Q = 8
REGION = 80
STRIDE = 12
SHORTEST = 40
RATE = 0.1
BLOCK_CHARS = 4_000_000
_codes: dict = {}


def _plain() -> np.ndarray:
    """Normal form of each code point below 65536: the letter or digit in lower case, or 32."""
    if "plain" not in _codes:
        chars = [chr(c) for c in range(0xD800)] + ["\ufffd"] * 0x800 + [chr(c) for c in range(0xE000, 0x10000)]
        _codes["plain"] = np.array([ord(low) if c.isalnum() and len(low := c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in chars], np.uint32)
    return _codes["plain"]


def collapse(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and for each input position (and the end) its place among them."""
    plain = np.where(codes < 0x10000, _plain()[np.minimum(codes, 0xFFFF)], codes)
    keep = plain != 32
    keep[1:] |= keep[:-1].copy()  # the first of a run of others stays, as a space
    place = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return plain[keep], place


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def normalise(text: str | None) -> str:
    return text_of(collapse(codes_of(text or ""))[0]).strip(" ")


def regions(length: int, size: int = REGION, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` characters that begin every ``stride``, and one at the end."""
    if length <= size:
        return [(0, length)]
    starts = list(range(0, length - size, stride))
    return [(a, a + size) for a in [*starts, length - size]]


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all runs of q code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, done, power = codes.astype(np.uint64), 1, 0x100000001B3
    while 2 * done <= q:  # runs of 1, 2, 4, ...
        h = h[:-done] * np.uint64(power) + h[done:]
        done, power = 2 * done, power * power & 0xFFFFFFFFFFFFFFFF
    h = h[:n].copy()
    for i in range(done, q):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n]
    return mix(h)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def banded_distances(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edit distance of each pattern (a row of m code points) to the nearest substring of its text (a row of m + lanes - 1) on diagonals 0 to lanes - 1."""
    n, m = patterns.shape
    lanes = texts.shape[1] - m + 1
    ramp, row = np.arange(lanes, dtype=np.int16), np.zeros((n, lanes), np.int16)
    for i in range(m):
        new = row + (texts[:, i : i + lanes] != patterns[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp  # gaps along the text
    return row.min(axis=1)


def banded_distance(region: str, text: str, budget: int) -> int:
    """Edit distance of ``region`` to the nearest substring of ``text``, if it is within ``budget``, else more than it."""
    m, n = len(region), len(text)
    wide = np.zeros(max(n + 2 * budget, m), np.uint32)  # room for diagonals that begin before the text or end after it
    wide[budget : budget + n] = codes_of(text)
    return int(banded_distances(codes_of(region)[None], wide[None])[0])


class Index:
    """A block of items: their sorted q-grams with item and place, and their regions."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, size: int = REGION, stride: int = STRIDE, rate: float = RATE, shortest: int = SHORTEST):
        self.size, self.q, self.stride, self.shortest, self.items, self.texts = size, q, stride, shortest, [], []
        hashes, first, least, budget, count = [], [0], [], [], []
        for item, text in items:
            text = normalise(text)
            if len(text) < q:
                continue
            self.items.append(item)
            self.texts.append(codes_of(text))
            hashes.append(qgrams(self.texts[-1], q))
            m = min(len(text), size)
            e = int(rate * m) if len(text) >= shortest else 0
            budget.append(e)
            least.append(max(1, m + 1 - q * (e + 1)))
            count.append(1 if len(text) <= size else -(-(len(text) - size) // stride) + 1)
            first.append(first[-1] + count[-1])
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.first, self.count, self.least, self.budget = np.array(first), np.array(count, np.int64), np.array(least, np.int64), np.array(budget, np.int64)
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        h = h[order]
        self.owner = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])[order]
        self.place = np.concatenate([*(np.arange(len(x), dtype=np.int32) for x in hashes), np.zeros(0, np.int32)])[order]
        self.keys, at = np.unique(h, return_index=True)
        self.at = np.append(at, len(h))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.band = 2 * max(1, int(rate * size))

    def region(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start and length of regions by number."""
        item = np.searchsorted(self.first, r, "right") - 1
        m = np.minimum(self.length[item], self.size)
        return item, np.minimum((r - self.first[item]) * self.stride, self.length[item] - m), m

    def search(self, column) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, regions found, least edits) for a column of texts."""
        data, off = buffers(column)
        if len(self.keys):
            for i, j in chunks(off, 1 << 19):
                for row, *found in self._search(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    yield row + i, *found

    def _search(self, data: np.ndarray, off: np.ndarray):
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
        codes, place = collapse(codes_of(data.tobytes().decode("utf-8", "replace")))
        begin = place[np.minimum(letters[off], len(place) - 1)]  # each document's first code point
        h = qgrams(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        h = h[at]
        k = np.searchsorted(self.keys, h)
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h
        at, k = at[hit], k[hit]
        doc = np.searchsorted(begin, at, "right") - 1
        inside = at + self.q <= begin[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        if not len(at):
            return
        # Documents are set apart by more than an item and its bands, so that a diagonal belongs to one of them.
        width, gap = self.band, int(self.length.max()) + 2 * self.band
        times = self.at[k + 1] - self.at[k]
        entry = np.repeat(self.at[k] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        owner, where = self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)
        diagonal = np.repeat(at + doc * gap, times) - where + gap
        left = begin[:-1] + np.arange(len(begin) - 1) * gap + gap  # diagonal 0 of each document
        found = []
        for shift in (0, width // 2):  # overlapping bands
            key = (owner << 40) | ((diagonal + shift) // width)
            order = np.argsort(key)
            starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            n = np.diff(np.append(starts, len(key)))
            many = n >= self.least[owner[order[starts]]]
            order = order[np.repeat(many, n)]  # hits of bands with enough of them for one region at least
            if not len(order):
                continue
            group, p = _distinct(key[order], where[order])
            item = group >> 40
            low = np.maximum(0, -(-(p - (self.size - self.q)) // self.stride))  # regions that hold the q-gram at p: low to high, and the last one
            high = np.minimum(p // self.stride, self.count[item] - 2)
            last = (p >= self.length[item] - np.minimum(self.length[item], self.size)).astype(np.int64)
            each = np.maximum(high - low + 1, 0)
            rep = np.repeat(np.arange(len(p)), each)
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(each) - each, each)
            g = np.concatenate([group[rep], group[last > 0]])
            r = np.concatenate([self.first[item[rep]] + low[rep] + nth, self.first[item[last > 0]] + self.count[item[last > 0]] - 1])
            order = np.lexsort((r, g))
            g, r = g[order], r[order]
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
            n = np.diff(np.append(starts, len(g)))
            ok = starts[n >= self.least[g[starts] >> 40]]
            low = (g[ok] & ((1 << 40) - 1)) * width - shift  # lowest diagonal of the band
            found.append((r[ok], low))
        if not found:
            return
        r, low = (np.concatenate(x) for x in zip(*found, strict=True))
        d = np.searchsorted(left - gap + width, low + width, "right") - 1
        sound = d >= 0
        r, low, d = r[sound], low[sound], d[sound]
        item, start, m = self.region(r)
        edits = self._verify(codes, begin, item, start, m, low - left[d] + start, d)
        ok = edits <= self.budget[item]
        best: dict[tuple[int, int], dict[int, int]] = {}
        for row, x, region, n in zip(d[ok].tolist(), item[ok].tolist(), r[ok].tolist(), edits[ok].tolist(), strict=True):
            of = best.setdefault((row, x), {})
            of[region] = min(n, of.get(region, n))
        for (row, x), of in best.items():
            yield row, self.items[x], len(of), min(of.values())

    def _verify(self, codes: np.ndarray, begin: np.ndarray, item: np.ndarray, start: np.ndarray, m: np.ndarray, low: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Edits of each region in the stretch of its band, which begins at ``low`` in the document."""
        edits = np.full(len(item), self.size, np.int64)
        e = self.budget[item]
        for size, budget in set(zip(m.tolist(), e.tolist(), strict=True)):
            every = np.flatnonzero((m == size) & (e == budget))
            for some in np.array_split(every, -(-len(every) // 2048)):
                wide = np.arange(size + self.band + 2 * budget)
                at = low[some, None] - budget + wide
                inside = (at >= 0) & (at < (begin[d[some] + 1] - begin[d[some]])[:, None])
                texts = np.where(inside, codes[np.clip(at + begin[d[some], None], 0, len(codes) - 1)], 0)
                patterns = np.stack([self.texts[x][s : s + size] for x, s in zip(item[some].tolist(), start[some].tolist(), strict=True)])
                edits[some] = banded_distances(patterns, texts)
                if self.length[item[some]].max() < self.shortest:  # short items: whole words
                    for i, x, t in zip(some.tolist(), item[some].tolist(), texts, strict=True):
                        text = text_of(np.where(t == 0, 32, t))
                        if edits[i] == 0 and f" {text_of(self.texts[x])} " not in f" {text} ":
                            edits[i] = self.size
        return edits


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[new], b[new]


def blocks_of(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[Index]:
    """Indexes of at most ``block_chars`` characters, or one item; an empty one for an empty benchmark."""
    block, size, any_yet = [], 0, False
    for item, text in benchmark.select(F.col(item_col).cast("long"), item_text).toLocalIterator():
        block.append((item, text))
        size += len(text or "")
        if size >= block_chars:
            yield Index(block)
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield Index(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_regions, least_edits) of every document that holds a region of an item."""
    given = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("regions", pa.int64()), ("edits", pa.int64())])

    def searcher(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.value.search(batch.column(1)))
                if found:
                    names = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([names, *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]], schema=schema)

        return run

    out = None
    for index in blocks_of(benchmark, item_col, item_text, block_chars):
        found = given.mapInArrow(searcher(docs.sparkSession.sparkContext.broadcast(index)), "doc_id long, item_id long, regions long, edits long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.sum("regions").alias("n_regions"), F.min("edits").alias("least_edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no region of an item; each is decided where it is read."""
    place = docs.columns.index(text_col)

    def filtering(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in index.value.search(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in blocks_of(benchmark, item_col, item_text, block_chars):
        docs = docs.mapInArrow(filtering(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_regions", "least_edits")
