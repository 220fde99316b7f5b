"""Exchange of keys between blocks of rows.

Rows are kept together in blocks of a few megabytes, each a compressed Arrow stream in one row of a written table.  A block asks about
its distinct keys (64-bit hashes, sorted, with columns of numbers): its questions are dealt out by ranges of the hash, each range
is folded by itself, and the answers go back to the blocks.  So a key costs one question for each block however often it occurs, a
question or an answer is a few bytes, and no task holds more than a block or a range.  Blocks and answers are written to the shared folder
before they are read, so a lost executor repeats a task, not the numbering of the blocks.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
LEAST_RANGES = 32


def freeze(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def thaw(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all().combine_chunks()


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes: high bytes that are all alike take no room."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def release() -> None:
    """Give memory that is no longer used back to the machine: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the size of each row, by its strings."""
    size = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            off = np.frombuffer(column.buffers()[1] or b"", np.int32)[column.offset : column.offset + len(column) + 1]
            size += np.diff(off)
    return size


def to_blocks(df: DataFrame, name: str, most: int = BLOCK_BYTES) -> DataFrame:
    """(block, n, bytes, data): all rows of ``df`` in blocks of about ``most`` bytes; a longer row stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows.num_rows]), pa.array([size]), pa.array([freeze(rows)], pa.binary())], ["block", "n", "bytes", "data"])

        for batch in batches:
            end = np.cumsum(_row_bytes(batch))
            i = 0
            while i < batch.num_rows:
                before = int(end[i - 1]) if i else 0
                j = int(np.searchsorted(end, before + most - size, "right"))
                if j == i and held:  # the next row does not fit
                    yield out()
                    held, size, number = [], 0, number + 1
                    continue
                j = max(j, i + 1)
                held.append(batch.slice(i, j - i))
                size += int(end[j - 1]) - before
                i = j
                if size >= most:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    return materialise(df.mapInArrow(run, "block long, n long, bytes long, data binary"), name, "none")


def range_count(blocks: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    return max(LEAST_RANGES, (blocks.agg(F.sum("bytes")).first()[0] or 0) // range_bytes)


def _edges(ranges: int) -> np.ndarray:
    """First hash of each range."""
    return np.array([-(-(r << 32) // ranges) for r in range(ranges)], np.uint64) << np.uint64(32)


def _cuts(h: np.ndarray, ranges: int) -> np.ndarray:
    return np.append(np.searchsorted(h, _edges(ranges)), len(h))


def exchange(blocks: DataFrame, ask: Callable, kinds: list, fold: Callable, answer, ranges: int, name: str) -> DataFrame:
    """(block, range, n, at, value): the answers to the questions of all blocks.

    ``ask(rows)`` gives sorted hashes and their columns of numpy types ``kinds``; ``fold(h, columns, block)`` gets all questions of
    a range, those of a block together and in order, and gives the places of those to be answered, ascending, with values of numpy type ``answer``.
    """
    names = [f"c{i}" for i in range(len(kinds))]
    asked = "range int, block long, n int, h binary" + "".join(f", {c} binary" for c in names)

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                h, columns = ask(thaw(data.as_buffer()))
                cut = _cuts(h, ranges)
                out = []
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    some = slice(cut[r], cut[r + 1])
                    packed = [pack(np.ascontiguousarray(c[some], k)) for c, k in zip(columns, kinds, strict=True)]
                    out.append((r, block, int(cut[r + 1] - cut[r]), pack(np.diff(h[some], prepend=np.uint64(0))), *packed))
                types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * (1 + len(kinds))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["range", "block", "n", "h", *names])
        release()

    def answers(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        n, block = group.column("n").to_pylist(), group.column("block").to_numpy()
        h = np.concatenate([np.cumsum(unpack(x, m, np.uint64), dtype=np.uint64) for x, m in zip(group.column("h").to_pylist(), n, strict=True)])
        columns = [np.concatenate([unpack(x, m, k) for x, m in zip(group.column(c).to_pylist(), n, strict=True)]) for c, k in zip(names, kinds, strict=True)]
        start = np.cumsum([0, *n])
        at, value = fold(h, columns, np.repeat(np.arange(len(n), dtype=np.int32), n))
        del h, columns
        release()
        cut = np.searchsorted(at, start)
        some = np.flatnonzero(np.diff(cut)).tolist()
        parts = [(slice(cut[i], cut[i + 1]), start[i]) for i in some]
        out = [
            pa.array(block[some], pa.int64()), pa.array([group.column("range")[0].as_py()] * len(some), pa.int32()), pa.array([int(s.stop - s.start) for s, _ in parts], pa.int32()),
            pa.array([pack((at[s] - first).astype(np.uint32)) for s, first in parts], pa.binary()), pa.array([pack(np.ascontiguousarray(value[s], answer)) for s, _ in parts], pa.binary()),
        ]
        return pa.table(out, ["block", "range", "n", "at", "value"])

    dealt = blocks.select("block", "data").mapInArrow(questions, asked)
    return materialise(dealt.groupBy("range").applyInArrow(answers, "block long, range int, n int, at binary, value binary"), name, "none")


def with_answers(blocks: DataFrame, answered: DataFrame, ask: Callable, use: Callable, answer, ranges: int, schema) -> DataFrame:
    """``use(rows, state, at, values)`` of every block, a table in ``schema``.

    ``ask(rows, True)`` gives the block's hashes and a state; ``at`` are the places among its hashes that have an answer, ``values`` the answers.
    """

    def run(given: pa.Table, told: pa.Table) -> pa.Table:
        if not given.num_rows:
            raise ValueError("answers without their block")
        rows = thaw(given.column("data")[0].as_buffer())
        h, state = ask(rows, True)
        cut = _cuts(h, ranges)
        at, values = [np.zeros(0, np.int64)], [np.zeros(0, answer)]
        for x in told.to_pylist():
            at.append(unpack(x["at"], x["n"], np.uint32).astype(np.int64) + cut[x["range"]])
            values.append(unpack(x["value"], x["n"], answer))
        out = use(rows, state, np.concatenate(at), np.concatenate(values))
        del rows, state, h, at, values
        release()
        return out

    return blocks.select("block", "data").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)
