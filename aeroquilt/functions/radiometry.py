"""Thermal radiometry, palettes and contrast, as column expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KELVIN = 273.15  # fixed value

# Colour stops from cold to hot.
PALETTES = {
    "arctic": [(0, 0, 40), (0, 30, 120), (20, 90, 190), (90, 170, 230), (200, 225, 245), (255, 230, 150), (255, 170, 30), (255, 110, 0)],
    "black_hot": [(255, 255, 255), (0, 0, 0)],
    "green_hot": [(0, 0, 0), (0, 90, 0), (40, 200, 40), (200, 255, 200)],
    "hot_metal": [(0, 0, 0), (120, 0, 0), (230, 50, 0), (255, 160, 0), (255, 240, 120), (255, 255, 255)],
    "iron": [(0, 0, 0), (32, 0, 110), (100, 0, 150), (165, 0, 150), (215, 40, 90), (240, 100, 20), (250, 160, 0), (255, 215, 60), (255, 255, 230)],
    "lava": [(0, 0, 0), (40, 0, 60), (110, 0, 80), (180, 20, 30), (230, 80, 0), (255, 160, 0), (255, 230, 100), (255, 255, 255)],
    "medical": [(0, 0, 0), (0, 0, 180), (0, 170, 255), (0, 200, 0), (255, 255, 0), (255, 120, 0), (230, 0, 0), (255, 255, 255)],
    "rainbow": [(0, 0, 135), (0, 0, 255), (0, 160, 255), (0, 255, 200), (60, 255, 0), (255, 255, 0), (255, 150, 0), (255, 40, 0), (180, 0, 0)],
    "rainbow_hc": [(0, 0, 0), (40, 0, 120), (0, 0, 255), (0, 200, 255), (0, 255, 0), (255, 255, 0), (255, 128, 0), (255, 0, 0), (255, 0, 255), (255, 255, 255)],
    "white_hot": [(0, 0, 0), (255, 255, 255)],
}
# Other names of the palettes.
ALIASES = {
    "blackhot": "black_hot", "fusion": "lava", "gray": "white_hot", "grayscale": "white_hot", "greyscale": "white_hot", "hotmetal": "hot_metal",
    "iron_red": "iron", "ironbow": "iron", "ironred": "iron", "rainbow_high_contrast": "rainbow_hc", "whitehot": "white_hot",
}


def transmission(distance: Column, humidity: Column, ambient: Column) -> Column:
    """Share of the radiation that passes ``distance`` metres of air, clamped to 0.05 .. 1."""
    water = humidity / 100.0 * F.exp(1.5587 + 0.06939 * ambient - 0.00027816 * ambient * ambient + 6.8455e-7 * F.pow(ambient, 3))
    s, r = F.sqrt(F.greatest(distance, F.lit(0.0))), F.sqrt(water)
    tau = 1.9 * F.exp(-s * (0.006569 - 0.002276 * r)) - 0.9 * F.exp(-s * (0.01262 - 0.00667 * r))
    return F.least(F.greatest(tau, F.lit(0.05)), F.lit(1.0))


def celsius(raw: Column, emissivity: Column, tau: Column, reflected: Column, ambient: Column) -> Column:
    """Object temperature of a raw count of 1/64 K (its two low bits dropped)."""
    t0 = F.shiftright(raw, 2) * 0.0625
    e = F.least(F.greatest(emissivity, F.lit(0.01)), F.lit(1.0))
    power = F.pow(t0, 4) - (1 - e) * tau * F.pow(reflected + KELVIN, 4) - (1 - tau) * F.pow(ambient + KELVIN, 4)
    return F.sqrt(F.sqrt(F.greatest(power, F.lit(0.0)) / (e * tau))) - KELVIN


def to_gray(value: Column, low: Column, high: Column) -> Column:
    """Survey-wide range to 0 .. 255, unrounded."""
    return (value - low) * (255.0 / F.greatest(high - low, F.lit(1e-6)))


def quantise(gray: Column) -> Column:
    """To an 8-bit level: half added, clipped, truncated."""
    return F.floor(F.least(F.greatest(gray + 0.5, F.lit(0.0)), F.lit(255.0))).cast("int")


def from_gray(gray: Column, low: Column, high: Column) -> Column:
    return low + gray * ((high - low) / 255.0)


def to_carrier(gray: Column) -> tuple[Column, Column]:
    """(high, low) bytes of a 16-bit code for gray levels -128 .. 384."""
    code = F.least(F.greatest(F.rint((gray + 128.0) * (65535.0 / 512.0)), F.lit(0.0)), F.lit(65535.0)).cast("int")
    return F.shiftright(code, 8), code.bitwiseAND(F.lit(255))


def from_carrier(high: Column, low: Column) -> Column:
    return (high * 256.0 + low) * (512.0 / 65535.0) - 128.0


def palette_name(name: str) -> str:
    key = name.lower().replace("-", "_").replace(" ", "_")
    key = ALIASES.get(key, name.lower() if name.lower() in PALETTES else key)
    if key not in PALETTES:
        raise ValueError(f"unknown palette {name!r}; there are {', '.join(sorted(PALETTES))}")
    return key


def palette_table(spark: SparkSession, palette="rainbow") -> DataFrame:
    """(gray, r, g, b), 256 rows; ``palette``: a name, a list of stops, or 256 colours."""
    stops = PALETTES[palette_name(palette)] if isinstance(palette, str) else [tuple(s) for s in palette]
    if len(stops) == 256:
        rows = [(i, *[int(min(255, max(0, c))) for c in s]) for i, s in enumerate(stops)]
    elif len(stops) < 2:
        raise ValueError("a palette needs at least two stops")
    else:
        rows = []
        for i in range(256):
            at = i / 255 * (len(stops) - 1)
            k = min(int(at), len(stops) - 2)
            rows.append((i, *[round(a + (b - a) * (at - k)) for a, b in zip(stops[k], stops[k + 1], strict=True)]))
    return spark.createDataFrame(rows, "gray int, r int, g int, b int")


def equalise_table(gray: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, gray, level) of histogram equalisation; levels that do not occur are left out."""
    by = by or []
    hist = gray.groupBy(*by, "gray").agg(F.count("*").alias("n"))
    one = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*one).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 rows each
    whole = Window.partitionBy(*one)
    hist = hist.withColumn("cdf", F.sum("n").over(before))
    low = F.min("cdf").over(whole)
    total = F.max("cdf").over(whole)
    level = F.least(F.greatest((F.col("cdf") - low) * (255.0 / F.greatest(total - low, F.lit(1))), F.lit(0.0)), F.lit(255.0))
    return hist.select(*by, "gray", level.alias("level"))
