"""Sizes and resolutions of page images: arithmetic on width and height; pixels are an engine's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resolution by kind of document.
DPI_BY_KIND = {"id_card": 250, "aadhar": 200, "pan": 200, "text": 150, "resume": 180, "general": 200}
#: Width, height and resolution of usual scans, tried in this order.
KNOWN_SIZES = (
    (2480, 3508, 300),
    (1654, 2339, 200),
    (2550, 3300, 300),
    (1700, 2200, 200),
    (600, 900, 200),
    (900, 600, 200),
    (1200, 800, 200),
    (1200, 1800, 200),
    (1600, 2400, 200),
    (2400, 3600, 300),
    (3000, 4000, 300),
    (3120, 4160, 300),
    (3300, 5100, 300),
    (3600, 4800, 300),
    (4000, 6000, 300),
    (800, 1200, 150),
    (1000, 1500, 150),
)
#: Bytes per pixel by colour mode.
PIXEL_BYTES = {"1": 1, "L": 1, "P": 1, "RGB": 3, "RGBA": 4, "CMYK": 4}


def render_dpi(kind: Column, width_points: Column, height_points: Column) -> Column:
    """Resolution to render a page at: by kind, 1.3 times for pages under 3 inches, 300 at most."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DPI_BY_KIND.items() for x in kv]), kind), F.lit(200))
    small = (width_points / 72 < 3) | (height_points / 72 < 3)
    return F.least(F.when(small, F.floor(base * F.lit(1.3))).otherwise(base), F.lit(300)).cast("int")


def source_dpi(width: Column, height: Column) -> Column:
    """Likely resolution of an image: a known size within 50 pixels, else one of like shape within a fifth, else by the longer side."""
    sizes = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(d).alias("dpi")) for w, h, d in KNOWN_SIZES])
    exact = F.filter(sizes, lambda s: (F.abs(width - s["w"]) < 50) & (F.abs(height - s["h"]) < 50))
    shape = F.when(width > 0, height / width).otherwise(1.0)
    alike = F.filter(
        sizes,
        lambda s: (F.abs(shape - s["h"] / s["w"]) < 0.1) & (F.abs(width - s["w"]) / s["w"] < 0.2) & (F.abs(height - s["h"]) / s["h"] < 0.2),
    )
    longest = F.greatest(width, height)
    by_side = F.when(longest >= 4000, 300).when(longest >= 2500, 250).when(longest >= 1500, 200).otherwise(150)
    return F.coalesce(F.get(exact, F.lit(0))["dpi"], F.get(alike, F.lit(0))["dpi"], by_side)


def downscale(images: DataFrame, threshold: int = 2800, target: int = 1800, min_dpi: int = 200) -> DataFrame:
    """Adds ``tier, scale, new_width, new_height`` to ``(width, height)``.

    Images with a side over ``threshold`` are brought to ``target`` pixels, those over 3500
    to at least 1200, and scaled back up if that leaves less than the tier's least
    resolution; images over 5000 pixels may lose 30 more. No side stays above 4000.
    """
    w, h = F.col("width"), F.col("height")
    longest = F.greatest(w, h)
    over = longest > threshold
    tier = F.when(~over, "none").when(longest > 3500, "aggressive").otherwise("conservative")
    least = F.when(longest > 5000, max(120, max(150, min_dpi - 50) - 30)).when(longest > 3500, max(150, min_dpi - 50)).otherwise(min_dpi)
    first = F.when(longest > 3500, F.lit(float(max(target, 1200))) / longest).otherwise(F.lit(float(target)) / longest)
    dpi = source_dpi(w, h) * F.col("_first")
    held = F.when(dpi < least, F.col("_first") * least / dpi).otherwise(F.col("_first"))
    side = F.greatest(F.floor(w * F.col("_held")), F.floor(h * F.col("_held")))
    safe = F.when(side > 4000, F.lit(3800.0) / side).otherwise(1.0)
    staged = images.withColumn("tier", tier).withColumn("_first", first).withColumn("_held", held).withColumn("_safe", safe)
    final = lambda c: F.when(over, F.floor(F.floor(c * F.col("_held")) * F.col("_safe"))).otherwise(c).cast("int")
    return staged.withColumns(
        {"scale": F.when(over, F.col("_held") * F.col("_safe")).otherwise(1.0), "new_width": final(w), "new_height": final(h)}
    ).drop("_first", "_held", "_safe")


def memory_bytes(width: Column, height: Column, mode: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PIXEL_BYTES.items() for x in kv])
    return width.cast("long") * height * F.coalesce(F.element_at(table, mode), F.lit(3))
