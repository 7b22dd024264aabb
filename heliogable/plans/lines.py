"""Queries of ridges, slope walks and strips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import lines as op
from heliogable.plans.base import bridge, query

# A walk for each roof's regions in order: level, steep and climbing steps.
STEPS = """st AS (SELECT roof_id AS walk_id, row_number() OVER (PARTITION BY roof_id ORDER BY region_id) AS i, region_id * 41 % 100 < 45 AS skipped,
  CASE WHEN region_id * 37 % 100 < 30 THEN 0.02 WHEN region_id * 37 % 100 < 65 THEN 3 ELSE 0.3 + (region_id * 53 % 100) / 500 END::DOUBLE AS slope FROM regions)"""
WALK = f"""{STEPS}, w AS (SELECT DISTINCT walk_id, 0::BIGINT AS i, 0::DOUBLE AS m, 0 AS taken, 0 AS run, false AS stopped FROM st
  UNION ALL SELECT walk_id, i, CASE WHEN odd THEN m WHEN m > 0.01 THEN 0.7 * m + 0.3 * v ELSE v END, CASE WHEN odd AND run >= 2 THEN taken ELSE taken + 1 END, CASE WHEN odd THEN run + 1 ELSE 0 END, odd AND run >= 2
  FROM (SELECT w.walk_id, st.i, m, taken, run, slope AS v, m > 0.01 AND taken >= 3 AND (slope / m > 1.6 OR slope / m < 0.15) AS odd FROM w JOIN st ON st.walk_id = w.walk_id AND st.i = w.i + 1 WHERE NOT stopped) AS t),
  ends AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY walk_id ORDER BY i DESC) = 1)"""


def _steps(spark, sf_dir):
    key = F.col("region_id") * 37 % 100
    slope = F.when(key < 30, 0.02).when(key < 65, 3.0).otherwise(0.3 + (F.col("region_id") * 53 % 100) / 500)
    place = F.row_number().over(Window.partitionBy("roof_id").orderBy("region_id"))
    return bridge(spark, sf_dir, "regions").select(F.col("roof_id").alias("walk_id"), place.cast("long").alias("i"), slope.alias("slope"), (F.col("region_id") * 41 % 100 < 45).alias("skipped"))


def _walks(steps):
    return op.slope_walk(steps.groupBy("walk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "slope"))), lambda s: s["slope"]).alias("steps")))


@query("slope_walk", f"WITH RECURSIVE {WALK} SELECT walk_id, round(m, 6) + 0.0 AS slope, taken, run AS outliers, stopped FROM ends", "regions")
def slope_walk(spark, sf_dir):
    return _walks(_steps(spark, sf_dir)).select("walk_id", fixed("slope", 6).alias("slope"), "taken", "outliers", "stopped")


@query("flat_run", f"""WITH RECURSIVE {WALK}, f AS (SELECT st.walk_id, st.i, abs(slope) < 0.2 * m AS flat FROM st JOIN ends USING (walk_id) WHERE m > 0.01),
  n AS (SELECT walk_id, i, flat AND lead(flat) OVER v AND lead(flat, 2) OVER v AS begins FROM f WINDOW v AS (PARTITION BY walk_id ORDER BY i)) SELECT walk_id, min(i) AS start, min(i) + 2 AS stop FROM n WHERE begins GROUP BY 1""", "regions")
def flat_run(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return op.flat_run(steps, _walks(steps))


@query("strip_termination", f"""WITH {STEPS}, n AS (SELECT *, skipped AND lag(skipped) OVER v AND lag(skipped, 2) OVER v AS ends FROM st WINDOW v AS (PARTITION BY walk_id ORDER BY i)), e AS (SELECT walk_id, min(i) FILTER (ends) AS stop FROM n GROUP BY 1)
  SELECT walk_id AS sweep_id, i FROM st JOIN e USING (walk_id) WHERE NOT skipped AND i < coalesce(stop, 1000000000)""", "regions")
def strip_termination(spark, sf_dir):
    return op.traced_strips(_steps(spark, sf_dir).withColumnRenamed("walk_id", "sweep_id"))


@query("ridge_thinning", """WITH r AS (SELECT scene_id, pid, x, z, y FROM points WHERE abs(z) <= 0.6 AND abs(x) <= 6), m AS (SELECT scene_id, min(x) AS s, median(y) AS h FROM r GROUP BY 1),
  b AS (SELECT r.scene_id, pid, floor((x - s) / 0.75)::BIGINT AS bin, round(abs(z) + abs(y - h) / 2, 9) AS score FROM r JOIN m USING (scene_id)) SELECT scene_id, pid, bin, score, (SELECT count(*) FROM b o WHERE o.scene_id = b.scene_id AND o.bin = b.bin AND (o.score, o.pid) < (b.score, b.pid)) < 2 AS ridge FROM b""", "points")
def ridge_thinning(spark, sf_dir):
    p = bridge(spark, sf_dir, "points").filter("abs(z) <= 0.6 and abs(x) <= 6")
    level = p.groupBy("scene_id").agg(F.percentile("y", 0.5).alias("level"))
    return op.thin_ridge(p.join(level, "scene_id").select("scene_id", "pid", F.col("x").alias("along"), F.col("z").alias("across"), (F.col("y") - F.col("level")).alias("rise")))


def _ridges(spark, sf_dir):
    """Edges between the knots of a 5 x 5 grid, so that many meet."""
    k = F.col("region_id")
    knots = {"x0": k % 5, "z0": F.floor(k / 5) % 5, "x1": F.floor(k / 25) % 5, "z1": F.floor(k / 125) % 5}
    df = bridge(spark, sf_dir, "regions").select(F.col("roof_id").alias("scene_id"), k.alias("edge_id"), *[v.cast("double").alias(c) for c, v in knots.items()])
    df = df.withColumns({"y0": (F.col("x0") + F.col("z0")) / 10, "y1": (F.col("x1") + F.col("z1")) / 10})
    return df.withColumn("length", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2 + (F.col("z1") - F.col("z0")) ** 2)).filter("length > 0")


@query("ridge_chain")
def ridge_chain(spark, sf_dir):
    df = op.main_ridges(_ridges(spark, sf_dir))
    return df.select("scene_id", *[fixed(c, 4).alias(c) for c in ("azimuth", "pitch", "length", "peak")], "edges")


def _segments(spark, sf_dir):
    r = bridge(spark, sf_dir, "regions")
    turn = F.radians(F.col("region_id") % 4 * 5)
    return r.select("roof_id", F.col("region_id").alias("line_id"), "x0", "z0", (F.col("x0") + 8 * F.cos(turn)).alias("x1"), (F.col("z0") + 8 * F.sin(turn)).alias("z1"), "confidence")


@query("collinear_merge")
def collinear_merge(spark, sf_dir):
    df = op.merge_collinear(_segments(spark, sf_dir))
    return df.select("roof_id", "line_id", fixed("length", 4).alias("length"), fixed("confidence", 4).alias("confidence"), "merged")
