"""Points laid on outlines from images: places in pixels, segments that hold points, planes draped over segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import first_true, num, shoelace
from heliogable.operators.graph import points_in
from heliogable.operators.planes import fit


def dots_to_local(dots: DataFrame) -> DataFrame:
    """Dots (lat, lng, x, z) with their image's bounds (south, west, north, east) and the cloud's (x0, z0, x1, z1): px, pz in metres.

    A side of no extent puts a dot in the middle; a dot without lat or lng keeps
    its own x and z.
    """
    c = F.col

    def across(at: str, low: str, high: str, first: str, last: str) -> Column:
        span = c(high) - c(low)
        share = F.when(span != 0, (c(at) - c(low)) / F.when(span != 0, span).otherwise(num(1))).otherwise(num(0.5))
        return c(first) + share * (c(last) - c(first))

    bare = c("lat").isNull() | c("lng").isNull()
    return dots.withColumns({"px": F.when(bare, c("x")).otherwise(across("lng", "west", "east", "x0", "x1")), "pz": F.when(bare, c("z")).otherwise(across("lat", "south", "north", "z0", "z1"))})


def pixel_scale(registered: Column, resolution: Column) -> Column:
    """Metres a pixel: the registration's where it is positive, else the image's."""
    return F.when(registered > 0, registered).otherwise(resolution)


def to_pixel(metres: Column, scale: Column, size: Column) -> Column:
    return metres / scale + size / 2


def from_pixel(pixel: Column, scale: Column, size: Column) -> Column:
    return (pixel - size / 2) * scale


def held_segments(points: DataFrame, masks: DataFrame, scale: float, width: int, height: int, least: int = 10) -> DataFrame:
    """(scene_id, segment, n) of the segments whose mask pixels (scene_id, segment, row, col) hold ``least`` points or more.

    Points count per pixel before they meet the masks; pixels outside the image
    hold none.
    """
    pixel = lambda name, size: F.bround(to_pixel(F.col(name), num(scale), num(size))).cast("long")
    counts = points.select("scene_id", pixel("z", height).alias("row"), pixel("x", width).alias("col")).groupBy("scene_id", "row", "col").agg(F.count("*").alias("n"))
    inside = counts.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return masks.join(inside, ["scene_id", "row", "col"]).groupBy("scene_id", "segment").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def drape(points: DataFrame, segments: DataFrame, least: int = 10, least_up: float = 0.01) -> DataFrame:
    """Planes over segments (scene_id, face_id, place, xs, zs, confidence) from the points inside; ``place`` is a segment's order.

    With ``least`` points a plane is fitted; with three or more too, at half the
    confidence; with fewer the scene's first fully fitted plane before it is
    taken on, at 0.3 of the confidence and with heights over its own corners.
    Segments without either, or of under three corners, have none.  ``source`` says which.
    A plane's area is its flat one over its normal's part upwards, ``least_up`` at least.
    """
    c = F.col
    outlines = segments.filter(F.size("xs") >= 3)
    inside = points.join(points_in(points, outlines), ["scene_id", "pid"])
    fitted = fit(inside, ("scene_id", "face_id")).select("scene_id", "face_id", "n", "nx", "ny", "nz", "mx", "my", "mz")
    heights = inside.groupBy("scene_id", "face_id").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    df = outlines.join(fitted, ["scene_id", "face_id"], "left").join(heights, ["scene_id", "face_id"], "left")
    df = df.withColumn("source", first_true((c("n") >= least, "points"), (c("n") >= 3, "sparse"), default="neighbour"))
    whole = F.when(c("source") == "points", F.struct("place", "nx", "ny", "nz", "mx", "my", "mz"))
    earlier = F.min(whole).over(Window.partitionBy("scene_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("lent", earlier).filter("source <> 'neighbour' or lent is not null")
    own = c("source") != "neighbour"
    df = df.withColumns({k: F.when(own, c(k)).otherwise(c(f"lent.{k}")) for k in ("nx", "ny", "nz", "mx", "my", "mz")})
    d = c("nx") * c("mx") + c("ny") * c("my") + c("nz") * c("mz")
    steep = F.abs("ny") <= 1e-10
    corner = lambda v: F.when(steep, c("my")).otherwise((d - c("nx") * v["x"] - c("nz") * v["z"]) / F.when(steep, num(1)).otherwise(c("ny")))
    df = df.withColumn("ys", F.transform(F.arrays_zip(c("xs").alias("x"), c("zs").alias("z")), corner))
    df = df.withColumns({"low": F.when(own, c("low")).otherwise(F.array_min("ys")), "high": F.when(own, c("high")).otherwise(F.array_max("ys")), "held": F.when(own, c("n")).otherwise(F.size("xs"))})
    df = df.withColumns({"pitch": F.degrees(F.acos(F.least(num(1), F.abs("ny")))), "azimuth": F.pmod(F.degrees(F.atan2("nx", "nz")), num(360)), "area": F.greatest(num(0.01), shoelace(c("xs"), c("zs")) / F.greatest(F.abs("ny"), num(least_up)))})
    kind = first_true(((c("area") < 5) & (c("low") > 2), "dormer"), ((c("area") < 15) & (c("high") < 3), "porch"), ((c("area") < 30) & (c("low") < 1.5), "garage"), default="main")
    sure = 0.6 * c("confidence") + 0.4 * F.least(num(1), c("held") / 200)
    share = first_true((c("source") == "points", 1.0), (c("source") == "sparse", 0.5), default=0.3)
    return df.select("scene_id", "face_id", "xs", "ys", "zs", "source", "pitch", "azimuth", "low", "high", "area", (c("pitch") < 2).alias("is_flat"), kind.alias("plane_type"), (sure * share).alias("confidence"), ((c("source") != "points") | (sure < 0.5)).alias("needs_review"))
