"""Files and kernels: round trips and brute force."""

import struct

import numpy as np
import pytest

from aeroquilt.operators import kernels as K
from aeroquilt.sources import geotiff, photos


@pytest.mark.parametrize("big", [False, True])
def test_geotiff_round_trip(spark, tmp_path, big):
    cells = [(r, c, float(r * 100 + c)) for r in range(40) for c in range(50) if not (r < 16 and c < 16)]
    grid = geotiff.Grid(50, 40, 32646, (1000.0, 2000.0), 0.5, -9999.0, 1, 16)
    geotiff.write(spark.createDataFrame(cells, "row int, col int, z double"), grid, f"file://{tmp_path}/a.tif", big)
    got, df = geotiff.read(spark, f"file://{tmp_path}/a.tif")
    assert got == grid
    assert {tuple(r) for r in df.where("z is not null").collect()} == set(cells) and df.count() == 2000


def jpeg(width, height, raw=b""):
    def ifd(entries, at):
        out, extra = struct.pack("<H", len(entries)), b""
        base = at + 2 + 12 * len(entries) + 4
        for tag, kind, n, data in entries:
            if len(data) > 4:
                out += struct.pack("<HHII", tag, kind, n, base + len(extra))
                extra += data
            else:
                out += struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0")
        return out + b"\0\0\0\0" + extra

    rational = lambda *v: struct.pack(f"<{2 * len(v)}I", *[x for a in v for x in (int(a * 100), 100)])
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, rational(33, 30, 0)), (3, 2, 2, b"E\0"), (4, 5, 3, rational(18, 15, 36)), (5, 1, 1, b"\1"), (6, 5, 1, rational(12.5))]
    main = [(0x10F, 2, 4, b"DJI\0"), (0x112, 3, 1, struct.pack("<H", 6)), (0x8825, 4, 1, struct.pack("<I", 200))]
    tiff = b"II*\0\x08\0\0\0" + ifd(main, 8)
    tiff = tiff.ljust(200, b"\0") + ifd(gps, 200)
    seg = lambda m, p: bytes([0xFF, m]) + struct.pack(">H", len(p) + 2) + p
    parts = [raw[i : i + 60000] for i in range(0, len(raw), 60000)]
    return b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + tiff) + b"".join(seg(0xE3, p) for p in parts) + seg(0xC0, b"\x08" + struct.pack(">HH", height, width) + b"\x03") + b"\xff\xda\0\0"


def test_photo_metadata_and_thermal(spark, tmp_path):
    raw = np.arange(128 * 96, dtype="<u2").tobytes()
    (tmp_path / "a.JPG").write_bytes(jpeg(96, 128, raw))
    (tmp_path / ".b.jpg").write_bytes(b"x")
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff")
    got = {r.name: r for r in photos.read_frames(spark, f"file://{tmp_path}").collect()}
    a = got["a.JPG"]
    assert set(got) == {"a.JPG", "broken.jpg"} and (a.width, a.height, a.make) == (128, 96, "DJI")
    assert abs(a.lat + 33.5) < 1e-9 and abs(a.lon - 18.26) < 1e-9 and a.alt == -12.5
    thermal = photos.read_thermal(spark, f"file://{tmp_path}")
    assert thermal.count() == 128 * 96 and thermal.where("row = 1 and col = 2").first().raw == 1 * a.thermal_cols + 2


def test_ransac_finds_a_planted_affine(spark):
    rng = np.random.default_rng(0)
    src = rng.uniform(0, 1000, (200, 2))
    A = np.array([[0.98, 0.1, 5], [-0.1, 1.02, -7]])
    dst = src @ A[:, :2].T + A[:, 2] + rng.normal(0, 0.3, (200, 2))
    dst[:70] = rng.uniform(0, 1000, (70, 2))
    rows = [(0, 1, k, *map(float, (*src[k], *dst[k]))) for k in range(200)] + [(0, 2, k, float(k), 1.0, 5.0, 2.0 * k) for k in range(10)]
    got = K.verify_pairs(spark.createDataFrame(rows, "i int, j int, k int, xi double, yi double, xj double, yj double")).toPandas()
    assert set(got.j) == {1} and len(got) >= 125 and abs(got.a[0] - 0.98) < 0.01 and abs(got.f[0] + 7) < 1


def test_semi_global_smooths_and_correlation_peaks():
    rng = np.random.default_rng(1)
    truth = np.where(np.arange(20) < 10, 2, 5)[None].repeat(16, 0)
    cost = np.abs(np.arange(8)[:, None, None] - truth) + rng.normal(0, 0.5, (8, 16, 20))
    raw, smooth = cost.argmin(0), K.semi_global(cost, 1.5, 4.0).argmin(0)
    assert (smooth == truth).mean() > 0.95 > (raw == truth).mean()
    b = rng.random((40, 50))
    score = K.correlate(b[7:19, 11:25], b)
    r, c, s = K.peak(score)
    assert abs(r - 7) < 0.5 and abs(c - 11) < 0.5 and s > 0.99
    one = b[3:15, 4:18]
    assert abs(score[3, 4] - np.corrcoef(one.ravel(), b[7:19, 11:25].ravel())[0, 1]) < 1e-9
