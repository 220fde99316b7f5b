"""Tiled, deflated GeoTIFF.  Executors compress tiles; the driver streams them into one file and appends the directory.

A raster is a DataFrame of cells (row, col, z) or (row, col, r, g, b, a).  Each tile is one group, so memory is a tile, whatever the raster.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF types and tags.
ASCII, SHORT, LONG, DOUBLE, LONG8 = 2, 3, 4, 12, 16
SIZES = {ASCII: 1, SHORT: 2, LONG: 4, DOUBLE: 8, LONG8: 8}
CODES = {SHORT: "H", LONG: "I", DOUBLE: "d", LONG8: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR = 256, 257, 258, 259, 262, 277, 284
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
BIG_FROM = 3_500_000_000


@dataclass(frozen=True)
class Grid:
    """Size, place and meaning of a raster; ``origin`` is the upper left corner."""

    width: int
    height: int
    epsg: int | None = None
    origin: tuple[float, float] | None = None
    pixel: float | None = None
    nodata: float | None = None
    bands: int = 1
    tile: int = 256


def tiles(cells: DataFrame, grid: Grid, level: int = 6) -> DataFrame:
    """(at, data): deflated tiles that hold any cell, numbered along rows of tiles."""
    t, across = grid.tile, -(-grid.width // grid.tile)
    names = ["z"] if grid.bands == 1 else list("rgba")
    kind = np.dtype("<f4") if grid.bands == 1 else np.dtype("u1")
    fill = 0.0 if grid.nodata is None else grid.nodata

    def run(group: pa.Table) -> pa.Table:
        out = np.full((t, t, grid.bands), fill if grid.bands == 1 else 0, kind)
        r, c = group.column("row").to_numpy() % t, group.column("col").to_numpy() % t
        for k, name in enumerate(names):
            v = group.column(name).to_numpy()
            out[r, c, k] = np.where(np.isnan(v), fill, v) if grid.bands == 1 else v
        return pa.table({"at": group.column("at").slice(0, 1), "data": pa.array([zlib.compress(out.tobytes(), level)], pa.binary())})

    inside = cells.where((F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width))
    at = F.floor(F.col("row") / t) * across + F.floor(F.col("col") / t)
    return inside.select("row", "col", *[F.col(n).cast("double" if grid.bands == 1 else "short") for n in names], at.cast("long").alias("at")).groupBy("at").applyInArrow(run, "at long, data binary")


def _directory(grid: Grid, offsets: list[int], counts: list[int], at: int, big: bool) -> bytes:
    place = LONG8 if big else LONG
    entries = {
        WIDTH: (LONG, [grid.width]), HEIGHT: (LONG, [grid.height]), BITS: (SHORT, [32] if grid.bands == 1 else [8] * grid.bands), COMPRESSION: (SHORT, [8]), PHOTOMETRIC: (SHORT, [1 if grid.bands == 1 else 2]),
        SAMPLES: (SHORT, [grid.bands]), PLANAR: (SHORT, [1]), TILE_WIDTH: (SHORT, [grid.tile]), TILE_HEIGHT: (SHORT, [grid.tile]), TILE_OFFSETS: (place, offsets), TILE_COUNTS: (place, counts), FORMAT: (SHORT, [3 if grid.bands == 1 else 1] * grid.bands),
    }
    if grid.bands == 4:
        entries[EXTRA] = (SHORT, [2])
    if grid.origin and grid.pixel:
        entries[PIXEL_SCALE] = (DOUBLE, [grid.pixel, grid.pixel, 0.0])
        entries[TIEPOINT] = (DOUBLE, [0.0, 0.0, 0.0, grid.origin[0], grid.origin[1], 0.0])
        keys = [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1]
        if grid.epsg:
            keys[3] = 3
            keys += [3072, 0, 1, grid.epsg]
        entries[GEO_KEYS] = (SHORT, keys)
    if grid.nodata is not None:
        entries[NODATA] = (ASCII, (f"{grid.nodata:g}".encode() + b"\0"))
    inline, wide = (8, 20) if big else (4, 12)
    head = struct.pack("<Q" if big else "<H", len(entries))
    extra_at, table, extra = at + len(head) + wide * len(entries) + (8 if big else 4), b"", b""
    for tag, (kind, values) in sorted(entries.items()):
        raw = values if kind == ASCII else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
        n = len(raw) // SIZES[kind]
        if len(raw) > inline:
            table += struct.pack("<HHQQ" if big else "<HHII", tag, kind, n, extra_at + len(extra))
            extra += raw + b"\0" * (-len(raw) % 8)
        else:
            table += struct.pack("<HHQ" if big else "<HHI", tag, kind, n) + raw.ljust(inline, b"\0")
    return head + table + b"\0" * (8 if big else 4) + extra


def write(cells: DataFrame, grid: Grid, path: str, big: bool | None = None) -> None:
    """One file at ``path``; tiles without cells share one empty tile.  The header names a directory that follows the tiles, so tile sizes are summed first."""
    spark = cells.sparkSession
    big = grid.width * grid.height * 4 > BIG_FROM if big is None else big
    from ..lineage import cut

    done = cut(tiles(cells, grid))
    size = {r["at"]: r["n"] for r in done.select("at", F.octet_length("data").alias("n")).collect()}  # one number per tile
    n = -(-grid.width // grid.tile) * -(-grid.height // grid.tile)
    one = np.dtype("<f4") if grid.bands == 1 else np.dtype("u1")
    empty = zlib.compress(np.full((grid.tile, grid.tile, grid.bands), (grid.nodata or 0) if grid.bands == 1 else 0, one).tobytes())
    start = 16 if big else 8
    offsets, counts, at = [start] * n, [len(empty)] * n, start + len(empty)
    for k in sorted(size):
        offsets[k], counts[k], at = at, size[k], at + size[k]
    at += at % 2
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)))
        out.write(bytearray(empty))
        written = start + len(empty)
        for row in done.orderBy("at").toLocalIterator():
            out.write(bytearray(row["data"]))
            written += len(row["data"])
        out.write(bytearray(b"\0" * (at - written) + _directory(grid, offsets, counts, at, big)))
    finally:
        out.close()


def parse(data: bytes) -> tuple[Grid, list[tuple[int, int]]]:
    """Grid and (offset, length) of each tile."""
    big = data[2:4] == b"\x2b\0"
    at = struct.unpack_from("<Q" if big else "<I", data, 8 if big else 4)[0]
    n = struct.unpack_from("<Q" if big else "<H", data, at)[0]
    at += 8 if big else 2
    tags = {}
    for i in range(n):
        p = at + i * (20 if big else 12)
        tag, kind, count = struct.unpack_from("<HHQ" if big else "<HHI", data, p)
        p += 12 if big else 8
        if SIZES.get(kind, 1) * count > (8 if big else 4):
            p = struct.unpack_from("<Q" if big else "<I", data, p)[0]
        tags[tag] = data[p : p + count] if kind == ASCII else struct.unpack_from(f"<{count}{CODES[kind]}", data, p) if kind in CODES else ()
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048)), None)
    tie, scale = tags.get(TIEPOINT), tags.get(PIXEL_SCALE)
    nodata = float(tags[NODATA].rstrip(b"\0")) if NODATA in tags else None
    grid = Grid(tags[WIDTH][0], tags[HEIGHT][0], epsg, (tie[3], tie[4]) if tie else None, scale[0] if scale else None, nodata, tags[SAMPLES][0], tags[TILE_WIDTH][0])
    return grid, list(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS], strict=True))


def read(spark: SparkSession, path: str) -> tuple[Grid, DataFrame]:
    """Grid, and cells in the form that ``write`` takes; no-data cells of one band are null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    grid, _ = parse(bytes(files.first()["content"]))
    names = ["z"] if grid.bands == 1 else list("rgba")[: grid.bands]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                g, where = parse(data)
                across = -(-g.width // g.tile)
                for k, (at, n) in enumerate(where):
                    a = np.frombuffer(zlib.decompress(data[at : at + n]), "<f4" if g.bands == 1 else "u1").reshape(g.tile, g.tile, g.bands)
                    r0, c0 = k // across * g.tile, k % across * g.tile
                    a = a[: g.height - r0, : g.width - c0]
                    r, c = np.indices(a.shape[:2]).astype(np.int32)
                    columns = [pa.array((r + r0).ravel()), pa.array((c + c0).ravel())]
                    for b in range(g.bands):
                        v = a[:, :, b].ravel()
                        columns.append(pa.array(v.astype(np.float64), mask=(v == g.nodata) if g.nodata is not None else np.isnan(v)) if g.bands == 1 else pa.array(v.astype(np.int16)))
                    yield pa.RecordBatch.from_arrays(columns, ["row", "col", *names])

    kind = "double" if grid.bands == 1 else "short"
    return grid, files.mapInArrow(run, "row int, col int, " + ", ".join(f"{n} {kind}" for n in names))
