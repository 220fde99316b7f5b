"""Photos: EXIF metadata and radiometric payloads out of JPEG files, parsed inside Arrow batches of Spark's binary source."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# EXIF tags and the sizes of their types.
MAKE, MODEL, ORIENTATION, EXIF_IFD, GPS_IFD = 0x10F, 0x110, 0x112, 0x8769, 0x8825
FOCAL, FOCAL_35, GPS_LAT_REF, GPS_LAT, GPS_LON_REF, GPS_LON, GPS_ALT_REF, GPS_ALT = 0x920A, 0xA405, 1, 2, 3, 4, 5, 6
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")


def segments(data: bytes):
    """(marker, payload) of a JPEG up to its scan."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def app_payload(data: bytes, marker: int = 0xE3) -> bytes:
    """All payloads of one application marker, joined: raw thermal counts use APP3."""
    return b"".join(p for m, p in segments(data) if m == marker)


def thermal_shape(size: int, width: int, height: int) -> tuple[int, int] | None:
    """(rows, columns) of raw 16-bit counts that fill ``size`` bytes: the photo's size or a half or quarter of it."""
    for k in (1, 2, 4):
        h, w = height // k, width // k
        if h >= 64 and w >= 64 and size == 2 * h * w:
            return h, w
    return None


def measurement(data: bytes) -> dict | None:
    """Radiometric parameters of an APP4 header, or None where the gain byte says that it cannot be measured."""
    head = app_payload(data, 0xE4)
    if len(head) < 0x81 or head[0x80] == 3:
        return None
    distance, humidity, emissivity, reflected, ambient = struct.unpack_from("<5f", head, 0x20)
    return {"distance": distance, "humidity": humidity * 100, "emissivity": emissivity, "reflected": reflected, "ambient": ambient}


def _directory(tiff: bytes, at: int, order: str) -> dict:
    out = {}
    if at + 2 > len(tiff):
        return out
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        p = at + 2 + 12 * i
        if p + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, p)
        size = TYPE_SIZE.get(kind, 0) * count
        q = p + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, p + 8)[0]
        if not size or q + size > len(tiff):
            continue
        if kind == 2:
            out[tag] = tiff[q : q + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            v = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", tiff, q)
            out[tag] = [a / b if b else None for a, b in zip(v[::2], v[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}[kind]}", tiff, q))
    return out


def _degrees(parts, ref, negative: str) -> float | None:
    if not parts or len(parts) < 3 or None in parts[:3]:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(ref or "").upper().startswith(negative) else value


def exif(data: bytes) -> dict:
    """Size (turned for orientations 5 to 8), make, model, position and focal lengths; None where a photo does not say."""
    out = dict.fromkeys(("width", "height", "make", "model", "lat", "lon", "alt", "focal_mm", "focal35", "thermal_rows", "thermal_cols"))
    turn = False
    for marker, p in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(p) >= 5:
            out["height"], out["width"] = struct.unpack_from(">HH", p, 1)
        elif marker == 0xE1 and p[:6] == b"Exif\0\0" and len(p) > 14:
            tiff = p[6:]
            order = "<" if tiff[:2] == b"II" else ">"
            main = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
            sub = _directory(tiff, main[EXIF_IFD][0], order) if EXIF_IFD in main else {}
            gps = _directory(tiff, main[GPS_IFD][0], order) if GPS_IFD in main else {}
            out["make"], out["model"] = main.get(MAKE), main.get(MODEL)
            turn = (main.get(ORIENTATION) or [1])[0] >= 5
            out["focal_mm"], out["focal35"] = (sub.get(FOCAL) or [None])[0], float(sub[FOCAL_35][0]) if sub.get(FOCAL_35) else None
            out["lat"], out["lon"] = _degrees(gps.get(GPS_LAT), gps.get(GPS_LAT_REF), "S"), _degrees(gps.get(GPS_LON), gps.get(GPS_LON_REF), "W")
            alt = (gps.get(GPS_ALT) or [None])[0]
            out["alt"] = -alt if alt is not None and (gps.get(GPS_ALT_REF) or [0])[0] == 1 else alt
    if turn:
        out["width"], out["height"] = out["height"], out["width"]
    if out["width"] and (shape := thermal_shape(len(app_payload(data)), out["width"], out["height"])):
        out["thermal_rows"], out["thermal_cols"] = shape
    return out


SCHEMA = "path string, name string, width int, height int, make string, model string, lat double, lon double, alt double, focal_mm double, focal35 double, thermal_rows int, thermal_cols int"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("make", pa.string()), ("model", pa.string()), *[(c, pa.float64()) for c in ("lat", "lon", "alt", "focal_mm", "focal35")], ("thermal_rows", pa.int32()), ("thermal_cols", pa.int32())])


def parse_frames(files: DataFrame) -> DataFrame:
    """One row per file of (path, content)."""

    def run(batches):
        for batch in batches:
            rows = [exif(c.as_py() or b"") | {"path": p, "name": p.rsplit("/", 1)[-1]} for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's binary source over photos; names with a leading dot are not read."""
    globs = ",".join(x for e in EXTENSIONS for x in (f"*.{e}", f"*.{e.upper()}"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "{" + globs + "}").load(folder).where(~F.substring_index("path", "/", -1).startswith("."))


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    return parse_frames(list_photos(spark, folder))


def read_thermal(spark: SparkSession, folder: str) -> DataFrame:
    """(name, row, col, raw) of the radiometric photos of a folder."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = c.as_py()
                e = exif(data)
                if e["thermal_rows"]:
                    raw = np.frombuffer(app_payload(data), "<u2").astype(np.int32)
                    at = np.arange(len(raw), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 1)[-1]] * len(raw)), pa.array(at // e["thermal_cols"]), pa.array(at % e["thermal_cols"]), pa.array(raw)], ["name", "row", "col", "raw"])

    return list_photos(spark, folder).select("path", "content").mapInArrow(run, "name string, row int, col int, raw int")
