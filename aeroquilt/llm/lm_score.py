"""Cross-entropy difference under matched n-gram models.

Tokens are the bytes of the text, A-Z lower-cased, so both models share one vocabulary whatever the languages.  The background model is counted
on all documents, the target model on the wanted ones; both are Witten-Bell interpolations of orders 1 to ``ORDER`` over the same n-grams.
A document's score is its mean per-token loss under the target less that under the background: lower is nearer to the target.

Counts are exact and unpruned.  Tasks pre-aggregate their n-grams before the shuffle.  For scoring, n-grams with at least
1 / ``FREQUENT`` of all tokens - at most ``FREQUENT`` of them, however large the corpus - are broadcast; all the rarer ones are joined by
(document, n-gram) rows, which by their rarity have no hot key.  Target ids are broadcast as integers up to ``MOST_IDS`` of them; more are joined.

Defined cases: a null or empty text has no tokens and null losses; every document starts after ``ORDER - 1`` start bytes; with no target
documents the target model is uniform; rows of one id are scored one by one; labels of ids that are not there are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .textnum import _LOWER, buffers, chunks, mix

ORDER = 5
VOCABULARY = 256
FREQUENT = 4_000_000
MOST_IDS = 4_000_000


def grams(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """One n-gram per byte, packed into an integer; documents one after another."""
    n, length = len(off) - 1, np.diff(off)
    pad = order - 1
    wide = np.zeros(len(data) + n * pad, np.int64)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * pad, length)
    wide[place] = _LOWER[data]
    g = np.zeros(len(data), np.int64)
    for i in range(order):
        g = (g << 8) | wide[place - pad + i]
    return g


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def count_grams(docs: DataFrame, text_col: str, target_col: str, order: int = ORDER, most: int = 6_000_000, target_ids=None) -> DataFrame:
    """(g, b, t): times in all documents and in target ones.  ``target_col`` is a flag, or an id to look up in the broadcast ``target_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"b": [], "t": []}

        def total(kind: str) -> tuple[np.ndarray, np.ndarray]:
            k, c = tally(np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]]))
            held[kind] = [(k, c)]
            return k, c

        def out() -> Iterator[pa.RecordBatch]:
            for kind in ("b", "t"):
                if held[kind]:
                    k, c = total(kind)
                    zero = np.zeros(len(c), np.int64)
                    for i in range(0, len(k), 1 << 18):
                        j = slice(i, i + (1 << 18))
                        yield pa.RecordBatch.from_arrays([pa.array(k[j]), pa.array(c[j] if kind == "b" else zero[j]), pa.array(c[j] if kind == "t" else zero[j])], ["g", "b", "t"])
                held[kind] = []

        for batch in batches:
            data, off = buffers(batch.column(0))
            if target_ids is None:
                target = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            else:
                ids = target_ids.value
                own = batch.column(1).fill_null(0).to_numpy()
                target = ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own if len(ids) else np.zeros(len(own), bool)
                target &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, j in chunks(off):
                o = off[i : j + 1] - off[i]
                g = grams(data[off[i] : off[j]], o, order)
                held["b"].append(tally(g))
                if target[i:j].any():
                    held["t"].append(tally(g[np.repeat(target[i:j], np.diff(o))]))
                if sum(len(x[0]) for x in held["b"]) > most:
                    if len(total("b")[0]) > most // 2:
                        yield from out()
        yield from out()

    return docs.select(text_col, target_col).mapInArrow(run, "g long, b long, t long").groupBy("g").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def fit(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, n, loss_t, loss_b) of every counted n-gram, in nats."""
    model = None
    for k in range(1, order + 1):
        at = counts if k == order else counts.groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
        context = F.shiftright("g", 8)
        seen = [F.sum("b").alias("nb"), F.sum("t").alias("nt"), F.sum((F.col("b") > 0).cast("long")).alias("kb"), F.sum((F.col("t") > 0).cast("long")).alias("kt")]
        whole = at.groupBy(context.alias("h")).agg(*seen)
        at = at.withColumn("h", context).join(whole, "h")
        if k == 1:
            p = {x: (F.col(x) + 1) / (F.col(f"n{x}") + VOCABULARY) for x in "bt"}
        else:
            low = model.select(F.col("g").alias("low"), F.col("pb").alias("qb"), F.col("pt").alias("qt"))
            at = at.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(low, "low")
            p = {x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"k{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"k{x}"))).otherwise(F.col(f"q{x}")) for x in "bt"}
        model = at.select("g", F.col("b").alias("n"), p["b"].alias("pb"), p["t"].alias("pt"))
    return model.select("g", "n", (-F.log("pt")).alias("loss_t"), (-F.log("pb")).alias("loss_b"))


class Losses:
    """Losses of the frequent n-grams in an open-addressed table."""

    def __init__(self, g: np.ndarray, t: np.ndarray, b: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(g) + 1))))
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.zeros((size, 2), np.float32), 0
        left, slot = np.arange(len(g)), self.slot(g)
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = g[left[free]]  # of several, the last one stays
            won = self.keys[slot] == g[left]
            self.values[slot[won], 0], self.values[slot[won], 1] = t[left[won]], b[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (mix(g.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        """Place of each n-gram in the table, or -1."""
        slot = self.slot(g)
        held = self.keys[slot]
        out = np.where(held == g, slot, -1)
        left = np.flatnonzero((held != g) & (held != -1))
        for step in range(1, self.probes + 1):
            if not len(left):
                break
            slot = (self.slot(g[left]) + step) & (len(self.keys) - 1)
            held = self.keys[slot]
            hit = held == g[left]
            out[left[hit]] = slot[hit]
            left = left[~hit & (held != -1)]
        return out


_SCORED = "doc_id long, row_key long, n long, t double, b double, rare array<long>, times array<long>"


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score), losses per token."""
    tokens = model.agg(F.sum("n")).first()[0] or 0
    bound = F.col("n") * F.lit(frequent) >= F.lit(tokens)
    common = model.where(bound).select("g", F.col("loss_t").cast("float"), F.col("loss_b").cast("float")).toArrow()  # at most ``frequent`` rows
    losses = docs.sparkSession.sparkContext.broadcast(Losses(*[common.column(i).to_numpy() for i in range(3)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = losses.value
        for batch in batches:
            data, off = buffers(batch.column(2))
            for i, j in chunks(off, 1 << 20):
                o = off[i : j + 1] - off[i]
                g = grams(data[off[i] : off[j]], o, order)
                at = known.find(g)
                hit = at >= 0
                doc = np.repeat(np.arange(j - i), np.diff(o))
                v = known.values[np.maximum(at, 0)]
                v[~hit] = 0
                sums = [np.bincount(doc, v[:, x], minlength=j - i) if len(doc) else np.zeros(j - i) for x in (0, 1)]
                rest = np.flatnonzero(~hit)
                rest = rest[np.lexsort((g[rest], doc[rest]))]
                rg, rd = g[rest], doc[rest]
                starts = np.flatnonzero(np.r_[True, (rg[1:] != rg[:-1]) | (rd[1:] != rd[:-1])]) if len(rg) else np.zeros(0, np.int64)
                times = np.diff(np.append(starts, len(rg)))
                lists = np.searchsorted(rd[starts], np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(o)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(lists, rg[starts]), pa.ListArray.from_arrays(lists, times)],
                    ["doc_id", "row_key", "n", "t", "b", "rare", "times"],
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    done = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text")).mapInArrow(run, _SCORED), "lm-scored")
    each = done.where(F.size("rare") > 0).select("doc_id", "row_key", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    each = each.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), F.col("x.rare").alias("g"), F.col("x.times").alias("times")).distinct()
    rare = each.join(model.where(~bound).select("g", "loss_t", "loss_b"), "g")
    rare = rare.groupBy("__id", "__row").agg(F.sum(F.col("times") * F.col("loss_t")).alias("rt"), F.sum(F.col("times") * F.col("loss_b")).alias("rb"))
    out = done.drop("rare", "times").join(rare, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__row")), "left")
    mean = lambda a, b: F.try_divide(F.col(a) + F.coalesce(F.col(b), F.lit(0.0)), F.col("n"))
    out = out.select("doc_id", F.col("n").alias("n_tokens"), mean("t", "rt").alias("loss_target"), mean("b", "rb").alias("loss_background"))
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of all ``docs``; ``target_ids`` (one column, ``id_col``) names the target documents."""
    wanted = target_ids.select(F.col(id_col).cast("long").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    given = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text"))
    if wanted.count() <= MOST_IDS:
        ids = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()))  # at most MOST_IDS of 8 bytes
        counted = count_grams(given, "__text", id_col, order, target_ids=ids)
    else:
        counted = count_grams(given.join(wanted.withColumn("__target", F.lit(True)), id_col, "left"), "__text", "__target", order)
    counts = materialise(counted, "lm-counts")
    model = materialise(fit(counts, order), "lm-model")
    return score(docs, model, id_col, text_col, order)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
