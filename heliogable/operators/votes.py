"""Labels for unsure points from what lies around them, direction by direction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.functions.columns import first_true

ROOFISH = ("roof", "flat_roof", "lower_roof", "ridge_dot", "near_ridge", "eave_dot", "valley_dot")
# The eight directions on the ground plan, from +x over +z.
TURNS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def plane_heights(points: DataFrame) -> DataFrame:
    """Mean height of the points of each plane (plane >= 0)."""
    return points.filter("plane >= 0").groupBy("scene_id", "plane").agg(F.avg("y").alias("level"))


def probes(points: DataFrame, radius: float = 1.5, steps: int = 5) -> DataFrame:
    """(scene_id, pid, turn, step, x, z): places along eight directions from each point."""
    one = radius / steps
    ways = [(t, a / math.hypot(a, b), b / math.hypot(a, b)) for t, (a, b) in enumerate(TURNS)]
    places = F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(s).alias("step"), (F.col("x") + a * one * s).alias("x"), (F.col("z") + b * one * s).alias("z")) for t, a, b in ways for s in range(1, steps + 1)])
    return points.select("scene_id", "pid", F.inline(places))


def ballots(unsure: DataFrame, labelled: DataFrame, radius: float = 1.5, steps: int = 5) -> DataFrame:
    """(scene_id, pid, turn, label, h): of each direction the point that the first probe with any within 0.6 steps is nearest to (ties: smaller pid).

    Each labelled point is dealt to the cells around its own, which are a little
    wider than that reach, as probes are the larger side; a minimum by key merges
    before the shuffle, so no direction's candidates are gathered.
    """
    reach = round(radius / steps * 0.6, 9)
    cell = lambda k: F.floor(F.col(k) / (reach * 1.01)).cast("long")
    around = lambda k: F.explode(F.array(*[cell(k) + d for d in (-1, 0, 1)]))
    seek = probes(unsure, radius, steps).withColumns({"gx": cell("x"), "gz": cell("z")})
    found = labelled.withColumn("gx", around("x")).withColumn("gz", around("z"))
    found = found.select("scene_id", "gx", "gz", F.col("pid").alias("other"), F.col("x").alias("ox"), F.col("z").alias("oz"), F.col("y").alias("h"), "label")
    gap = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("z") - F.col("oz")) ** 2)
    met = seek.join(found, ["scene_id", "gx", "gz"]).withColumn("gap", F.round(gap, 9)).filter(F.col("gap") <= reach)
    first = F.min_by(F.struct("label", "h"), F.struct("step", "gap", "other"))
    return met.groupBy("scene_id", "pid", "turn").agg(first.alias("v")).select("scene_id", "pid", "turn", "v.*")


def directional_votes(points: DataFrame, low: float = 2.0, least: int = 3) -> DataFrame:
    """(scene_id, pid, label): new labels of points (scene_id, pid, x, y, z, plane, label) labelled unsure, where the directions around agree.

    Rules in order: a label of three quarters of the votes (six at least) that
    fits in height; roofs of 0.6; an eave between two roofs and two grounds;
    trees, unless on a plane; low ground; roofs of half at their height.
    """
    c = F.col
    unsure = points.filter("label = 'unsure'")
    votes = ballots(unsure, points.filter("label <> 'unsure'"))
    by_label = votes.groupBy("scene_id", "pid", "label").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.min("turn").alias("first"))
    roof = c("label").isin(*ROOFISH)
    mean = lambda cond: F.sum(F.when(cond, c("h"))) / F.sum(F.when(cond, c("n")))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))
    df = by_label.groupBy("scene_id", "pid").agg(
        F.sum("n").alias("n"), (F.sum("h") / F.sum("n")).alias("mean"), F.min_by(F.struct("label", "n"), F.struct(-c("n"), c("first"))).alias("top"),
        count(roof).alias("roofs"), count(c("label") == "ground").alias("grounds"), count(c("label") == "tree").alias("trees"), mean(roof).alias("roof_h"), mean(c("label") == "ground").alias("ground_h"),
    ).filter(F.col("n") >= least)
    df = df.join(unsure.select("scene_id", "pid", "y", "plane"), ["scene_id", "pid"]).join(plane_heights(points), ["scene_id", "plane"], "left")
    off = lambda k: F.round(F.abs(c("y") - c(k)), 9)
    on_plane = lambda most: F.coalesce(off("level") < most, F.lit(False))
    top, strong = c("top.label"), c("top.n") >= F.greatest(F.lit(6), F.floor(c("n") * 0.75))
    fits = first_true((top.isin(*ROOFISH), F.when(c("level").isNotNull(), off("level") < 2.0).otherwise(off("mean") < 1.5)), (top == "ground", c("y") < low), default=True)
    label = first_true(
        (strong & fits, top),
        ((c("roofs") * 10 >= c("n") * 6) & (on_plane(1.5) | (off("roof_h") < 1.0)), "roof"),
        ((c("roofs") >= 2) & (c("grounds") >= 2) & (off("roof_h") < off("ground_h")) & (c("y") > c("ground_h") + 0.5), "eave_dot"),
        ((c("trees") * 2 > c("n")), F.when(on_plane(1.0), F.lit(None)).otherwise(F.lit("tree"))),
        ((c("grounds") * 2 > c("n")) & (c("y") < low), "ground"),
        ((c("roofs") * 2 >= c("n")) & (off("roof_h") < 0.8), "roof"),
    )
    return df.withColumn("label", label).filter("label is not null").select("scene_id", "pid", "label")
