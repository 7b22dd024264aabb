"""Image regions and lines as tables: rejection, scores, overlaps, coverage, suppression."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import first_true, flags, num, total

REASONS = ("vegetation", "texture", "roof_mask_overlap", "too_small", "too_large", "aspect_ratio", "compactness", "centrality", "vertex_count")


@dataclass(frozen=True)
class Config:
    """Limits of the image stage; ``profile`` picks a set, keywords override it."""

    profile: str = "high_precision"
    min_area: float = 4.0
    max_area: float = 300.0
    max_aspect: float = 6.0
    min_compactness: float = 0.20
    margin: float = 0.05
    min_overlap: float = 0.5
    max_green: float = 0.35
    max_texture: float = 900.0
    nms_overlap: float = 0.15


# What the second profile relaxes.
_PROFILES = {"high_precision": {}, "high_recall": {"min_area": 2.0, "min_compactness": 0.12, "max_aspect": 8.0, "min_overlap": 0.35}}


def make_config(profile: str = "high_precision", **overrides) -> Config:
    return replace(Config(profile=profile, **_PROFILES.get(profile, {})), **overrides)


def rejection(regions: DataFrame, config: Config, width: float, height: float) -> DataFrame:
    """Regions with ``reason``, the first of the ordered rules that turns one down, null where none does."""
    c = F.col
    leafy = (c("veto") < 0.45) & (c("tree_signals") >= 3)
    need = F.when(c("veto") >= 0.45, num(min(config.min_overlap, 0.30))).otherwise(num(config.min_overlap))
    cx, cz = c("x0") + c("w") / 2, c("z0") + c("h") / 2
    mx, mz = float(int(width * config.margin)), float(int(height * config.margin))
    reason = first_true(
        (leafy & (c("green") > config.max_green), "vegetation"), (leafy & (c("texture") * 2000 > config.max_texture), "texture"), (c("overlap") < need, "roof_mask_overlap"), (c("area") < config.min_area, "too_small"), (c("area") > config.max_area, "too_large"),
        (c("aspect") > config.max_aspect, "aspect_ratio"), (c("compactness") < config.min_compactness, "compactness"), ((cx < mx) | (cx > width - mx) | (cz < mz) | (cz > height - mz), "centrality"), (c("vertices") < 3, "vertex_count"),
    )
    return regions.withColumn("reason", reason)


def tree_signals(regions: DataFrame, concentration: Column, solidity: Column) -> DataFrame:
    """With ``tree_signals``: round with many corners, no main directions, green, rough, close to a disc."""
    c = F.col
    signs = ((c("compactness") > 0.55) & (c("vertices") > 8), (c("vertices") >= 4) & (concentration < 0.5), c("green") > 0.25, c("texture") * 2000 > 700, (solidity > 0.80) & (c("compactness") > 0.6))
    return regions.withColumn("tree_signals", total([s.cast("int") for s in signs]).cast("long"))


def boundary_scores(corners: DataFrame) -> DataFrame:
    """Of boundaries (region_id, i, x, z): corners, share of long sides, share of the two main directions (12 bins of 15 degrees)."""
    ring = Window.partitionBy("region_id").orderBy("i")
    nxt = lambda k: F.coalesce(F.lead(k).over(ring), F.first(k).over(ring))
    df = corners.withColumns({"dx": nxt("x") - F.col("x"), "dz": nxt("z") - F.col("z")})
    df = df.withColumn("len", F.sqrt(F.col("dx") ** 2 + F.col("dz") ** 2)).withColumn("bin", (F.floor(F.round(F.pmod(F.degrees(F.atan2("dz", "dx")), num(180)), 6) / 15) % 12).cast("int"))
    df = df.withColumn("round", F.sum("len").over(Window.partitionBy("region_id")))
    bins = df.groupBy("region_id", "bin").agg(F.count("*").alias("n"))
    top = bins.withColumn("rank", F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("n"), "bin"))).groupBy("region_id").agg((F.sum(F.when(F.col("rank") <= 2, F.col("n"))) / F.sum("n")).alias("concentration"))
    sides = df.groupBy("region_id").agg(F.count("*").alias("corners"), (F.sum(F.when(F.col("len") > F.col("round") * 0.08, F.col("len")).otherwise(num(0))) / F.max("round")).alias("straight"))
    return sides.join(top, "region_id")


def roof_veto(df: DataFrame) -> Column:
    """0 to 1: how much a region with boundary scores looks like a roof, so that it isn't taken for a tree."""
    c = F.col
    corners = first_true((c("corners") <= 6, 0.20), (c("corners") <= 10, 0.10), default=0.0)
    compact = first_true((c("compactness") > 0.5, 0.15), (c("compactness") > 0.3, 0.08), default=0.0)
    large = first_true((c("area_px") > 5000, 0.10), (c("area_px") > 2000, 0.05), default=0.0)
    solid = F.when(c("solidity") > 0.85, num(0.10)).otherwise(num(0))
    return F.least(num(1), c("straight") * 0.25 + corners + c("concentration") * 0.20 + compact + large + solid)


def overlaps(masks: DataFrame) -> DataFrame:
    """Of mask pixels (roof_id, region_id, row, col): for each pair that shares any, the shared count, IoU, shares of each, and whether it is flagged."""
    c = F.col
    # Pixels are shuffled once, by image row; Spark takes exploded masks for as small as what they come from, so neither side of a join is to be broadcast by guess.
    n = int(masks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = masks.select("roof_id", "row", "col", "region_id").repartition(n, "roof_id", "row")
    held = rows.groupBy("roof_id", "row", "col").agg(F.array_sort(F.collect_list("region_id")).alias("held")).filter(F.size("held") > 1)
    each = held.select("roof_id", "held", F.posexplode("held").alias("at", "p"))
    pairs = each.select("roof_id", "p", F.explode(F.slice("held", c("at") + 2, F.size("held"))).alias("q")).filter("p < q")
    both = pairs.groupBy("roof_id", "p", "q").agg(F.count("*").alias("shared"))
    size = rows.groupBy("roof_id", "region_id").agg(F.count("*").alias("n"))
    for k in "pq":
        both = both.join(size.select("roof_id", c("region_id").alias(k), c("n").alias(f"n_{k}")).hint("merge"), ["roof_id", k])
    df = both.withColumns({"iou": c("shared") / (c("n_p") + c("n_q") - c("shared")), "of_p": c("shared") / c("n_p"), "of_q": c("shared") / c("n_q")})
    return df.withColumn("flagged", F.greatest("of_p", "of_q") > 0.20)


def suppress(regions: DataFrame, limit: float, order: str = "area") -> DataFrame:
    """Regions that stay when, from the largest down, each drops those it overlaps by more than ``limit`` of the smaller one's box; roofs are small groups."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([order, "region_id"], ascending=[False, True])
        rows, kept = list(g[["region_id", "x0", "z0", "w", "h"]].itertuples(index=False)), []
        for r in rows:
            for k in kept:
                over = max(0.0, min(r.x0 + r.w, k.x0 + k.w) - max(r.x0, k.x0)) * max(0.0, min(r.z0 + r.h, k.z0 + k.h) - max(r.z0, k.z0))
                if over > limit * min(r.w * r.h, k.w * k.h):
                    break
            else:
                kept.append(r)
        return pd.DataFrame({"roof_id": g["roof_id"].iloc[0], "region_id": [k.region_id for k in kept]})

    columns = ["roof_id", "region_id", "x0", "z0", "w", "h"]
    return regions.select(*columns, *([order] if order not in columns else [])).groupBy("roof_id").applyInPandas(one, "roof_id long, region_id long")


def coverage(roof: DataFrame, planes: DataFrame) -> DataFrame:
    """Pixels of roofs and planes (roof_id, row, col): covered share, plane pixels outside, and a level."""
    both = roof.distinct().withColumn("r", F.lit(1)).join(planes.distinct().withColumn("p", F.lit(1)), ["roof_id", "row", "col"], "full_outer")
    df = both.groupBy("roof_id").agg(F.count("r").alias("roof"), F.count("p").alias("planes"), F.count_if(F.col("r").isNotNull() & F.col("p").isNotNull()).alias("covered"))
    share = F.when(F.col("roof") > 0, 100 * F.col("covered") / F.when(F.col("roof") > 0, F.col("roof")).otherwise(1)).otherwise(num(0))
    df = df.withColumn("share", share).withColumn("outside", F.col("planes") - F.col("covered"))
    return df.withColumn("level", first_true((F.col("share") >= 70, "good"), (F.col("share") >= 40, "partial"), (F.col("share") >= 10, "poor"), default="failed"))


def diagnostics(regions: DataFrame) -> DataFrame:
    c = F.col
    box = c("w") * c("h")
    return regions.withColumn("flags", flags((c("area") > 150, "likely_scale_error"), ((c("green") > 0.20) & (c("veto") < 0.45), "likely_tree_bleed"), (c("overlap") < 0.60, "likely_boundary_bleed"), ((box > 0) & (c("area") > box * 0.95), "likely_boundary_inflation")))


def obstruction_kind(area: Column, aspect: Column, circularity: Column) -> Column:
    return first_true((circularity > 0.75, F.when(area < 1, F.lit("vent")).otherwise(F.lit("pipe"))), ((aspect < 1.5) & (area > 1), "chimney"), ((aspect > 1.5) & (area > 0.5), "skylight"), default="unknown")


def merge_lines(lines: DataFrame, other: DataFrame, turn: float = 10, near: float = 0.3) -> DataFrame:
    """First lines, and those others that no first line doubles: within ``turn`` degrees, middles nearer than ``near`` of the longer."""
    c = F.col
    a, b = other.alias("o"), lines.alias("l")
    off = F.abs(c("o.angle") - c("l.angle"))
    off = F.least(off, 180 - off)
    gap = F.sqrt((c("o.mx") - c("l.mx")) ** 2 + (c("o.mz") - c("l.mz")) ** 2)
    on = (c("o.roof_id") == c("l.roof_id")) & (off <= turn) & (gap < near * F.greatest("o.length", "l.length"))
    return lines.unionByName(a.join(b, on, "left_anti"))


def settings_hash(config: Config) -> str:
    """The first 16 hex digits of the sha256 of the settings as sorted JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:16]


def material(hue: Column, saturation: Column, value: Column) -> Column:
    """A roof's material by mean colour."""
    return first_true((saturation < 40, F.when(value < 90, F.lit("asphalt_shingle")).otherwise(F.lit("metal"))), ((hue < 15) | (hue > 165), "clay_tile"), ((hue >= 15) & (hue <= 30), "wood_shake"), default="unknown")


def dark_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels (roof_id, row, col, s, v) in shadow: value under the roof's 8th percentile and saturation under 80."""
    limit = pixels.groupBy("roof_id").agg(F.percentile("v", 0.08).alias("limit"))
    return pixels.join(limit, "roof_id").filter((F.col("v") < F.col("limit")) & (F.col("s") < 80)).drop("limit")
