"""Queries of the CAD family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import cad as op
from heliogable.plans.base import bridge, query, table

HIP = """s AS (SELECT face_id, pitch, azimuth, height, x1 - x0 AS w, z1 - z0 AS h, x0, x1, z0, z1 FROM faces),
  hip AS (SELECT *, greatest(w, h) AS len, least(w, h) AS sh, w >= h AS wide, face_id % 16 AS bits FROM s),
  geo AS (SELECT *, sh / 2 AS inset, CASE WHEN wide THEN x0 ELSE x1 END AS ax, z0 AS az, x1 AS bx, CASE WHEN wide THEN z0 ELSE z1 END AS bz, CASE WHEN wide THEN x1 ELSE x0 END AS cx, z1 AS cz, x0 AS dx, CASE WHEN wide THEN z1 ELSE z0 END AS dz FROM hip)"""


def _hips(spark, sf_dir):
    f = bridge(spark, sf_dir, "faces")
    bit = lambda k: F.shiftright("face_id", k).bitwiseAND(F.lit(1)) == 1
    return op.hip_geometry(f.select("face_id", "pitch", "azimuth", "height", F.array("x0", "x1", "x1", "x0").alias("xs"), F.array("z0", "z0", "z1", "z1").alias("zs"), F.array(*[bit(k) for k in range(4)]).alias("gone")))


@query("hip_geometry", f"""WITH {HIP} SELECT face_id, round(inset, 5) + 0.0 AS inset, round(CASE WHEN wide THEN x0 + inset ELSE (x0 + x1) / 2 END, 5) + 0.0 AS r0x, round(CASE WHEN wide THEN (z0 + z1) / 2 ELSE z0 + inset END, 5) + 0.0 AS r0z,
  round(CASE WHEN wide THEN x1 - inset ELSE (x0 + x1) / 2 END, 5) + 0.0 AS r1x, round(CASE WHEN wide THEN (z0 + z1) / 2 ELSE z1 - inset END, 5) + 0.0 AS r1z, round(inset * tan(radians(pitch)) + 0.12, 5) + 0.0 AS ridge_y FROM geo""", "faces")
def hip_geometry(spark, sf_dir):
    return _hips(spark, sf_dir).select("face_id", fixed("inset", 5).alias("inset"), *[fixed(F.col(f"{p}.{k}"), 5).alias(f"{p}{k}") for p in ("r0", "r1") for k in "xz"], fixed("ridge_y", 5).alias("ridge_y"))


@query("section_geometry", f"""WITH {HIP}, k AS (SELECT unnest([0, 1, 2, 3]) AS section),
  t AS (SELECT face_id, section, len, sh, bits & 1 > 0 AS d0, bits & 2 > 0 AS d1, bits & 4 > 0 AS d2, bits & 8 > 0 AS d3 FROM geo, k WHERE (bits >> section) & 1 = 0)
  SELECT face_id, section, round(CASE WHEN NOT d2 AND NOT d3 THEN CASE WHEN section < 2 THEN sh * sh / 4 ELSE (len + (CASE WHEN d0 THEN len / 2 ELSE len / 2 - sh / 2 END) + (CASE WHEN d1 THEN len / 2 ELSE len / 2 - sh / 2 END)) * sh / 4 END
    WHEN d2 AND d3 THEN len * sh / 2 WHEN section < 2 THEN 3 * len * sh / 8 ELSE len * sh / 4 END, 7) + 0.0 AS area FROM t""", "faces")
def section_geometry(spark, sf_dir):
    return op.section_areas(_hips(spark, sf_dir)).select("face_id", "section", fixed("area", 7).alias("area"))


@query("hip_lines", f"""WITH {HIP}, b AS (SELECT face_id, bits & 1 > 0 AS d0, bits & 2 > 0 AS d1, bits & 4 > 0 AS d2, bits & 8 > 0 AS d3 FROM geo),
  l AS (SELECT face_id, 'a-r0' AS line FROM b WHERE NOT d2 AND NOT d3 AND NOT d0 UNION ALL SELECT face_id, 'd-r0' FROM b WHERE NOT d2 AND NOT d3 AND NOT d0 UNION ALL SELECT face_id, 'b-r1' FROM b WHERE NOT d2 AND NOT d3 AND NOT d1
   UNION ALL SELECT face_id, 'c-r1' FROM b WHERE NOT d2 AND NOT d3 AND NOT d1 UNION ALL SELECT face_id, CASE WHEN d0 THEN 'm0' ELSE 'r0' END || '-' || CASE WHEN d1 THEN 'm1' ELSE 'r1' END FROM b WHERE NOT d2 AND NOT d3
   UNION ALL SELECT face_id, 'mf-mb' FROM b WHERE d2 AND d3 AND NOT (d0 AND d1) UNION ALL SELECT face_id, 'mf-p' FROM b WHERE d2 AND NOT d3 AND NOT d0 AND NOT d1 UNION ALL SELECT face_id, 'd-p' FROM b WHERE d2 AND NOT d3 AND NOT d0
   UNION ALL SELECT face_id, 'c-p' FROM b WHERE d2 AND NOT d3 AND NOT d1 UNION ALL SELECT face_id, 'mb-p' FROM b WHERE d3 AND NOT d2 AND NOT d0 AND NOT d1 UNION ALL SELECT face_id, 'a-p' FROM b WHERE d3 AND NOT d2 AND NOT d0 UNION ALL SELECT face_id, 'b-p' FROM b WHERE d3 AND NOT d2 AND NOT d1)
  SELECT face_id, line FROM l""", "faces")
def hip_lines(spark, sf_dir):
    return op.hip_lines(_hips(spark, sf_dir))


@query("face_properties", """SELECT face_id, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor(azimuth / 45 + 0.5) % 8 + 1)::INT] AS direction, round(height * 3.28084, 1) + 0.0 AS height_ft, round(12 * tan(radians(pitch)), 1) + 0.0 AS slope_12, round((x1 - x0) * (z1 - z0) * 10.7639, 0) + 0.0 AS area_ft2,
  round(round((x1 - x0) * 3.28084, 1) + round((z1 - z0) * 3.28084, 1), 1) + 0.0 AS half_round_ft FROM faces""", "faces")
def face_properties(spark, sf_dir):
    df = op.properties(_hips(spark, sf_dir))
    return df.select("face_id", "direction", fixed("height_ft", 1).alias("height_ft"), fixed("slope_12", 1).alias("slope_12"), fixed("area_ft2", 0).alias("area_ft2"), fixed(F.get("sides_ft", F.lit(0)) + F.get("sides_ft", F.lit(1)), 1).alias("half_round_ft"))


@query("undo_history")
def undo_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_id") % 5 == 3, F.lit("undo")).when(F.col("event_id") % 7 == 4, F.lit("redo")).otherwise(F.lit("do"))
    return op.history(e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), action.alias("action"), F.col("event_id").alias("state")))
