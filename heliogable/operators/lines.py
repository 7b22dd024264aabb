"""Chains, bins and runs along ridges, slope walks and strips.

The order-dependent folds take a scene's edges or one walk at a time: a walk has
at most 300 steps and a scene as many edges as its planes share, so both are
small groups whatever the number of scenes.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import num

EDGE = ("x0", "y0", "z0", "x1", "y1", "z1")
LINE = ("x0", "z0", "x1", "z1")


def main_ridges(edges: DataFrame, snap: float = 0.5) -> DataFrame:
    """Main ridge of each scene from its ridge edges (scene_id, edge_id, x0 .. z1, length): the longest, grown at both ends.

    Edges join, from the longest down and over again until none fits, whose end
    lies within ``snap`` of an end of the chain.  Returns the chain's ends on the
    ground plan, azimuth from +z, pitch, length (sum over its edges), peak and
    number of edges.  Ties in length go to the smaller edge_id.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "edge_id"], ascending=[False, True])
        ends = [((r.x0, r.y0, r.z0), (r.x1, r.y1, r.z1), r.length) for r in g.itertuples(index=False)]
        head, tail, total = ends[0]
        rest, grew = ends[1:], True
        while grew:
            grew, left = False, []
            for a, b, size in rest:
                for near, far in ((a, b), (b, a)):
                    if math.dist(near, tail) < snap:
                        tail = far
                        break
                else:
                    for near, far in ((a, b), (b, a)):
                        if math.dist(near, head) < snap:
                            head = far
                            break
                    else:
                        left.append((a, b, size))
                        continue
                total, grew = total + size, True
            rest = left
        dx, dy, dz = (t - h for h, t in zip(head, tail))
        flat = math.hypot(dx, dz)
        pitch = math.degrees(math.atan2(abs(dy), flat)) if flat > 0.01 else 0.0
        row = [g["scene_id"].iloc[0], head[0], head[2], tail[0], tail[2], math.degrees(math.atan2(dx, dz)) % 360, pitch, total, max(head[1], tail[1]), len(ends) - len(rest)]
        return pd.DataFrame([row], columns=["scene_id", *LINE, "azimuth", "pitch", "length", "peak", "edges"])

    schema = "scene_id long, x0 double, z0 double, x1 double, z1 double, azimuth double, pitch double, length double, peak double, edges long"
    return edges.select("scene_id", "edge_id", *EDGE, "length").groupBy("scene_id").applyInPandas(one, schema)


def thin_ridge(points: DataFrame, width: float = 0.75, kept: int = 2) -> DataFrame:
    """Ridge points (scene_id, pid, along, across, rise) with their bin along the ridge and whether they stay ridge.

    Of each bin the ``kept`` points of smallest |across| + |rise| / 2 stay (ties:
    smaller pid); ``rise`` is the height over the ridge's median.  A bin is cut
    by rank, which Spark limits before the shuffle.
    """
    start = points.groupBy("scene_id").agg(F.min("along").alias("_start"))
    df = points.join(start, "scene_id").withColumns({"bin": F.floor((F.col("along") - F.col("_start")) / width), "score": F.round(F.abs("across") + F.abs("rise") * 0.5, 9)})
    best = F.row_number().over(Window.partitionBy("scene_id", "bin").orderBy("score", "pid"))
    return df.withColumn("ridge", best <= kept).select("scene_id", "pid", "bin", "score", "ridge")


def slope_walk(walks: DataFrame, start: float = 0.0, settle: int = 3, streak: int = 3) -> DataFrame:
    """Of walks (walk_id, steps: array of slopes in order): slope, steps taken, outliers and whether the walk was stopped.

    The slope is a moving average, 0.7 of the old and 0.3 of the new.  After
    ``settle`` steps a step over 1.6 or under 0.15 of it is an outlier, which
    counts as a step but leaves the average; the ``streak``-th outlier in a row
    ends the walk and isn't taken.  A null array is an empty walk, a null step
    is passed over.
    """

    def step(s: Column, v: Column) -> Column:
        known = s["slope"] > 0.01
        ratio = v / F.when(known, s["slope"]).otherwise(num(1))
        odd = known & (s["taken"] >= settle) & ((ratio > 1.6) | (ratio < 0.15))
        run = F.when(odd, s["run"] + 1).otherwise(F.lit(0))
        over = run >= streak
        mean = F.when(odd, s["slope"]).when(known, 0.7 * s["slope"] + 0.3 * v).otherwise(v)
        moved = F.struct(mean.alias("slope"), F.when(over, s["taken"]).otherwise(s["taken"] + 1).alias("taken"), run.alias("run"), over.alias("stopped"))
        return F.when(s["stopped"] | v.isNull(), s).otherwise(moved)

    zero = F.struct(num(start).alias("slope"), F.lit(0).alias("taken"), F.lit(0).alias("run"), F.lit(False).alias("stopped"))
    steps = F.coalesce(F.col("steps"), F.array().cast("array<double>"))
    return walks.withColumn("_w", F.aggregate(steps, zero, step)).select("walk_id", "_w.slope", F.col("_w.taken").alias("taken"), F.col("_w.run").alias("outliers"), F.col("_w.stopped").alias("stopped"))


def first_run(rows: DataFrame, key: str, place: str, holds: Column, least: int = 3) -> DataFrame:
    """(key, start, stop): the first run of ``least`` rows or more in a row that hold, by its first place and that of its ``least``-th row."""
    by = Window.partitionBy(key).orderBy(place)
    # Rows of a run share the difference between their place among all and among those that hold.
    df = rows.select(key, place, F.coalesce(holds, F.lit(False)).alias("_holds"), F.row_number().over(by).alias("_all")).filter("_holds")
    df = df.withColumn("_run", F.col("_all") - F.row_number().over(by))
    inside = Window.partitionBy(key, "_run").orderBy(place)
    df = df.withColumn("_nth", F.row_number().over(inside)).filter(F.col("_nth") <= least)
    runs = df.groupBy(key, "_run").agg(F.min(place).alias("start"), F.max(place).alias("stop"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return runs.groupBy(key).agg(F.min_by(F.struct("start", "stop"), "start").alias("r")).select(key, "r.*")


def flat_run(steps: DataFrame, slopes: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    """(walk_id, start, stop): where a walk's steps (walk_id, i, slope) first stay flat, under ``share`` of its moving slope; walks of a slope over 0.01."""
    df = steps.join(slopes.filter("slope > 0.01").select("walk_id", (share * F.col("slope")).alias("_flat")), "walk_id")
    return first_run(df, "walk_id", "i", F.abs("slope") < F.col("_flat"), least)


def traced_strips(strips: DataFrame, least: int = 3) -> DataFrame:
    """Strips (sweep_id, i, skipped) that a sweep traces: those not skipped before ``least`` skips in a row end it."""
    end = first_run(strips, "sweep_id", "i", F.col("skipped"), least).select("sweep_id", "stop")
    return strips.join(end, "sweep_id", "left").filter(~F.col("skipped") & (F.col("stop").isNull() | (F.col("i") < F.col("stop")))).select("sweep_id", "i")


def merge_collinear(lines: DataFrame, turn: float = 10.0, gap: float = 0.5) -> DataFrame:
    """Lines (roof_id, line_id, x0, z0, x1, z1, confidence) merged with later ones in order that point the same way and begin or end near them.

    A line takes over the next within ``turn`` degrees with two ends within
    ``gap``, becomes the segment between the farthest two of the four ends with
    the higher confidence, and goes on from there.  ``merged`` counts lines.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rest = [(int(r.line_id), ((r.x0, r.z0), (r.x1, r.z1)), r.confidence) for r in g.sort_values("line_id").itertuples(index=False)]
        heading = lambda e: math.degrees(math.atan2(e[1][1] - e[0][1], e[1][0] - e[0][0])) % 180
        out = []
        while rest:
            (name, ends, sure), *others = rest
            rest, merged = [], 1
            for line in others:
                apart = abs(heading(ends) - heading(line[1]))
                if min(apart, 180 - apart) <= turn and min(math.dist(p, q) for p in ends for q in line[1]) <= gap:
                    four = [*ends, *line[1]]
                    ends = max(((p, q) for i, p in enumerate(four) for q in four[i + 1 :]), key=lambda e: math.dist(*e))
                    sure, merged = max(sure, line[2]), merged + 1
                else:
                    rest.append(line)
            out.append((g["roof_id"].iloc[0], name, *ends[0], *ends[1], math.dist(*ends), sure, merged))
        return pd.DataFrame(out, columns=["roof_id", "line_id", *LINE, "length", "confidence", "merged"])

    schema = "roof_id long, line_id long, x0 double, z0 double, x1 double, z1 double, length double, confidence double, merged long"
    return lines.select("roof_id", "line_id", *LINE, "confidence").groupBy("roof_id").applyInPandas(one, schema)
