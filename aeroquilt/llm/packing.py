"""Token sequences packed by bounded-space best fit.

Texts never leave the task that reads them: each becomes rows of (document, piece, length, checksum), and only these are shuffled.
Rows are dealt to shards by hash.  A shard fills a fixed number of open bins; the bins still open at its end go to a next level of fewer shards, until
one shard is left.  A shard holds ``SHARD_FILLS`` times the tokens that its open bins can, so each level passes on at most that part of
its tokens, whatever their lengths: levels end, no task sees more than a shard, and no bin stays half empty because its shard ended.

Defined cases: a null or empty text is the end id alone; rows of one id are packed one by one; a document longer than a sequence is
cut into full pieces and a last one, and every full piece is a sequence of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .textnum import buffers, chunks
from .wordpieces import Encoder

CAPACITY = 4096
OPEN_BINS = 64
SHARD_FILLS = 16
CHUNK_BYTES = 1 << 19  # of text whose words are looked up at once
_encoders: dict = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.asarray([end_id], "<u4")
        for batch in batches:
            names, (data, off) = batch.column(0).to_pylist(), buffers(batch.column(1))
            for i, j in chunks(off, CHUNK_BYTES):
                ids, at = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids.astype("<u4"), at[1:], tail)  # the end id after each document
                at = at + np.arange(len(at))
                raw, out = memoryview(ids).cast("B"), ([], [], [], [], [])
                for name, a, b in zip(names[i:j], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for piece, start in enumerate(range(a, b, capacity)):
                        stop = min(b, start + capacity)
                        for column, value in zip(out, (name, piece, start - a, stop - start, zlib.crc32(raw[4 * start : 4 * stop])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    given = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit over a fixed number of open bins; free spaces are bits of one integer, the fullest bin closes first."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.bits, self.by_free, self.n_open, self.made = capacity, open_bins, 0, {}, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free, self.made = self.made, self.capacity, self.made + 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.n_open += 1
        return b, self.capacity - free

    def unfinished(self) -> set[int]:
        return {b for bins in self.by_free.values() for b in bins}


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _shard_packer(given: list[str], capacity: int, open_bins: int, level: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        group = group.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, n = BestFit(capacity, open_bins), group.num_rows
        bin_of, offset, place = np.empty(n, np.int64), np.empty(n, np.int64), bins.place
        for i, x in enumerate(group.column("length").to_numpy()):
            bin_of[i], offset[i] = place(int(x))
        open_yet = np.zeros(bins.made, bool)
        if not last:
            open_yet[list(bins.unfinished())] = True
        gone = open_yet[bin_of] if n else np.zeros(0, bool)
        ids = pa.array(((level << 56) | (shard << 32)) + bin_of, pa.int64(), mask=gone)
        return group.select(given).append_column("sequence_id", ids).append_column("offset", pa.array(offset, pa.int64(), mask=gone))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_fills: int = SHARD_FILLS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    pieces = materialise(pieces, "pieces")
    given = pieces.columns
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "start", "length")
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rest, done, level = pieces.where(F.col("length") < capacity), [full], 0
    while True:
        tokens = rest.agg(F.sum("length")).first()[0] or 0
        shards = max(1, tokens // (max(2, shard_fills) * open_bins * capacity))  # passes on 1 / shard_fills of its tokens at most
        dealt = rest.withColumn("order", key).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(level)), F.lit(shards)).cast("int"))
        packed = dealt.groupBy("shard").applyInArrow(_shard_packer(given, capacity, open_bins, level, shards == 1), _PACKED)
        if shards == 1:
            done.append(packed)
            break
        packed = materialise(packed, "packed")
        done.append(packed.where(F.col("sequence_id").isNotNull()))
        rest, level = packed.where(F.col("sequence_id").isNull()).select(given), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(docs, id_col, text_col, path, end_id, capacity), capacity, open_bins)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
