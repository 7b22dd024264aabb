"""Queries of the per-pixel shading family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import shading as op
from heliogable.plans.base import bridge, query
from heliogable.plans.solar import LAT, LNG, POSITION, SAMPLES, SKY

# A section for each face: its rectangle, risen by its pitch along z (azimuths of 0 and 180 only).
RISE = "tan(radians(pitch % 50)) * (z1 - z0)"
SECTIONS = f"sec AS (SELECT scene_id, face_id AS section_id, x0, x1, z0, z1, elevation + 3 AS y0, elevation + 3 + {RISE} AS y1 FROM faces)"
FRAME = f"""{SECTIONS}, fr AS (SELECT *, sqrt((y1 - y0) ** 2 + (z1 - z0) ** 2) AS slope, (z1 - z0) / sqrt((y1 - y0) ** 2 + (z1 - z0) ** 2) AS ny, -(y1 - y0) / sqrt((y1 - y0) ** 2 + (z1 - z0) ** 2) AS nz FROM sec),
  size AS (SELECT *, ceil(round((x1 - x0) / 0.5, 9))::INT AS width, ceil(round(slope / 0.5, 9))::INT AS height FROM fr)"""
# Along v, rows run from the high z end: v = n x u = (0, nz, -ny).
PIXELS = f"""{FRAME}, px0 AS (SELECT size.*, a.r AS row, b.c AS col FROM size, LATERAL (SELECT unnest(range(0, height)) AS r) a, LATERAL (SELECT unnest(range(0, width)) AS c) b),
  px AS (SELECT *, x0 + (col + 0.5) * 0.5 AS x, y1 + (row + 0.5) * 0.5 * nz AS y, z1 - (row + 0.5) * 0.5 * ny AS z FROM px0 WHERE row + 0.5 < round(slope / 0.5, 9) AND col <= floor(round((x1 - x0) / 0.5 - 0.5, 9)))"""


def _sections(spark, sf_dir):
    f = bridge(spark, sf_dir, "faces")
    y0, y1 = F.col("elevation") + 3, F.col("elevation") + 3 + F.tan(F.radians(F.col("pitch") % 50)) * (F.col("z1") - F.col("z0"))
    corner = lambda x, y, z: F.struct(F.col(x).alias("x"), y.alias("y"), F.col(z).alias("z"))
    return f.select("scene_id", F.col("face_id").alias("section_id"), F.array(corner("x0", y0, "z0"), corner("x1", y0, "z0"), corner("x1", y1, "z1"), corner("x0", y1, "z1")).alias("corners"), F.lit(0.5).alias("resolution"))


def _chimneys(spark, sf_dir):
    f = bridge(spark, sf_dir, "faces").filter("face_id % 2 = 0")
    cx, cz = (F.col("x0") + F.col("x1")) / 2, (F.col("z0") + F.col("z1")) / 2
    return f.select("scene_id", F.col("face_id").alias("obstruction_id"), F.array(cx - 0.6, cx + 0.6, cx + 0.6, cx - 0.6).alias("xs"), F.array(cz - 0.6, cz - 0.6, cz + 0.6, cz + 0.6).alias("zs"), (F.col("elevation") + 2).alias("base_y"), (F.col("elevation") + 8).alias("top_y"), F.lit(None).cast("long").alias("owner_id"))


def _trees(spark, sf_dir):
    return bridge(spark, sf_dir, "faces").filter("face_id % 3 = 0").select("scene_id", (F.col("x0") - 1.2).alias("x"), (F.col("z1") + 0.8).alias("z"), F.lit(0.0).alias("base_y"), (F.col("elevation") + 9).alias("peak_y"), F.lit(1.5).alias("radius"))


@query("section_frame", f"WITH {FRAME} SELECT section_id, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, width, height FROM size", "faces")
def section_frame(spark, sf_dir):
    return op.frames(_sections(spark, sf_dir)).select("section_id", fixed("ny", 6).alias("ny"), fixed("nz", 6).alias("nz"), "width", "height")


@query("raster_mask", f"WITH {PIXELS} SELECT section_id, row::INT AS row, col::INT AS col, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM px", "faces")
def raster_mask(spark, sf_dir):
    return op.pixels(op.frames(_sections(spark, sf_dir))).select("section_id", "row", "col", *[fixed(a, 5).alias(a) for a in "xyz"])


CHIMNEYS = "ch AS (SELECT scene_id, face_id AS obstruction_id, (x0 + x1) / 2 AS cx, (z0 + z1) / 2 AS cz, elevation + 2 AS lo, elevation + 8 AS hi FROM faces WHERE face_id % 2 = 0)"


@query("footprint_exclusion", f"WITH {PIXELS}, {CHIMNEYS} SELECT section_id, row::INT AS row, col::INT AS col FROM px WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.scene_id = px.scene_id AND px.x >= cx - 0.6 AND px.x < cx + 0.6 AND px.z > cz - 0.6 AND px.z < cz + 0.6)", "faces")
def footprint_exclusion(spark, sf_dir):
    px = op.pixels(op.frames(_sections(spark, sf_dir)))
    return op.exclude_footprints(px, _chimneys(spark, sf_dir).select("scene_id", "xs", "zs")).select("section_id", "row", "col")


@query("prism_triangles", f"""WITH {CHIMNEYS}, k AS (SELECT unnest(range(0, 10)) AS t), q AS (SELECT ch.*, t, [cx - 0.6, cx + 0.6, cx + 0.6, cx - 0.6] AS xs, [cz - 0.6, cz - 0.6, cz + 0.6, cz + 0.6] AS zs FROM ch, k)
  SELECT obstruction_id, t::INT AS t, round(CASE WHEN t < 8 THEN xs[(t // 2 + 1)::INT] ELSE xs[1] END, 5) + 0.0 AS ax, round(CASE WHEN t >= 8 THEN hi ELSE lo END, 5) + 0.0 AS ay, round(CASE WHEN t >= 8 THEN zs[(t - 8 + 3)::INT] WHEN t % 2 = 0 THEN zs[((t // 2 + 1) % 4 + 1)::INT] ELSE zs[(t // 2 + 1)::INT] END, 5) + 0.0 AS cz FROM q""", "faces")
def prism_triangles(spark, sf_dir):
    return op.triangles(_chimneys(spark, sf_dir)).select("obstruction_id", "t", fixed(F.col("a.x"), 5).alias("ax"), fixed(F.col("a.y"), 5).alias("ay"), fixed(F.col("c.z"), 5).alias("cz"))


BEAMS = f"""{SAMPLES}, {POSITION}, {SKY}, sun AS (SELECT sample, cos(radians(elevation)) * sin(radians(azimuth)) AS dx, sin(radians(elevation)) AS dy, -cos(radians(elevation)) * cos(radians(azimuth)) AS dz, ghi, dni, dhi FROM sky WHERE up > 0)"""
EVEN = f"{PIXELS}, {BEAMS}, light AS (SELECT sum(dhi * 73) AS sky, sum(ghi * 73) AS glo FROM sun), fb AS (SELECT fr.*, sample, dx, dy, dz, dni * (dy * ny + dz * nz) * 73 AS beam FROM fr, sun WHERE dy * ny + dz * nz > 0 AND dni > 0)"


@query("per_pixel_open", f"WITH {EVEN}, bm AS (SELECT section_id, sum(beam) AS beams FROM fb GROUP BY 1) SELECT px.section_id, px.row::INT AS row, px.col::INT AS col, round((sky * (1 + ny) / 2 + glo * 0.2 * (1 - ny) / 2 + coalesce(beams, 0)) / 1000, 4) + 0.0 AS kwh_m2 FROM px CROSS JOIN light LEFT JOIN bm USING (section_id)", "faces")
def per_pixel_open(spark, sf_dir):
    df = op.bake(spark, _sections(spark, sf_dir), None, None, LAT, LNG, mode="none")
    return df.select("section_id", "row", "col", fixed("kwh_m2", 4).alias("kwh_m2"))


# The oracle's box test is the slab method on the open-bottomed box, its tree test the quadratic formula.
BLOCKED = f"""{EVEN}, {CHIMNEYS}, tr AS (SELECT scene_id, x0 - 1.2 AS tx, z1 + 0.8 AS tz, (elevation + 9) / 2 AS ty, 1.5 AS rr, (elevation + 9) / 2 AS ry FROM faces WHERE face_id % 3 = 0),
  free AS (SELECT * FROM px WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.scene_id = px.scene_id AND px.x >= cx - 0.6 AND px.x < cx + 0.6 AND px.z > cz - 0.6 AND px.z < cz + 0.6)),
  ray AS (SELECT p.scene_id, p.section_id, p.row, p.col, p.x AS ox, p.y + 0.02 * p.ny AS oy, p.z + 0.02 * p.nz AS oz, b.sample, b.dx, b.dy, b.dz, b.beam FROM free p JOIN fb b ON p.section_id = b.section_id),
  cap AS (SELECT DISTINCT r.section_id, r.row, r.col, r.sample FROM ray r JOIN ch ON r.scene_id = ch.scene_id CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f) WHERE
    CASE f WHEN 0 THEN dy <> 0 AND (hi - oy) / dy BETWEEN 1e-6 AND 80 AND abs(ox + dx * (hi - oy) / dy - cx) <= 0.6 AND abs(oz + dz * (hi - oy) / dy - cz) <= 0.6
    WHEN 1 THEN abs(dx) > 1e-7 AND (cx - 0.6 - ox) / dx BETWEEN 1e-6 AND 80 AND abs(oz + dz * (cx - 0.6 - ox) / dx - cz) <= 0.6 AND oy + dy * (cx - 0.6 - ox) / dx BETWEEN lo AND hi
    WHEN 2 THEN abs(dx) > 1e-7 AND (cx + 0.6 - ox) / dx BETWEEN 1e-6 AND 80 AND abs(oz + dz * (cx + 0.6 - ox) / dx - cz) <= 0.6 AND oy + dy * (cx + 0.6 - ox) / dx BETWEEN lo AND hi
    WHEN 3 THEN abs(dz) > 1e-7 AND (cz - 0.6 - oz) / dz BETWEEN 1e-6 AND 80 AND abs(ox + dx * (cz - 0.6 - oz) / dz - cx) <= 0.6 AND oy + dy * (cz - 0.6 - oz) / dz BETWEEN lo AND hi
    ELSE abs(dz) > 1e-7 AND (cz + 0.6 - oz) / dz BETWEEN 1e-6 AND 80 AND abs(ox + dx * (cz + 0.6 - oz) / dz - cx) <= 0.6 AND oy + dy * (cz + 0.6 - oz) / dz BETWEEN lo AND hi END),
  ell AS (SELECT *, (dx * dx + dz * dz) / (rr * rr) + dy * dy / (ry * ry) AS qa, ((ox - tx) * dx + (oz - tz) * dz) / (rr * rr) + (oy - ty) * dy / (ry * ry) AS qb, ((ox - tx) ** 2 + (oz - tz) ** 2) / (rr * rr) + (oy - ty) ** 2 / (ry * ry) - 1 AS qc FROM ray JOIN tr USING (scene_id)),
  leaf AS (SELECT DISTINCT section_id, row, col, sample FROM ell WHERE qb * qb - qa * qc > 0 AND ((-qb + sqrt(greatest(0, qb * qb - qa * qc))) / qa BETWEEN 1e-6 AND 80 OR (-qb - sqrt(greatest(0, qb * qb - qa * qc))) / qa BETWEEN 1e-6 AND 80)),
  dark AS (SELECT * FROM cap UNION SELECT * FROM leaf)"""


ALL_RAYS = BLOCKED.replace("free AS (SELECT * FROM px WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.scene_id = px.scene_id AND px.x >= cx - 0.6 AND px.x < cx + 0.6 AND px.z > cz - 0.6 AND px.z < cz + 0.6))", "free AS (SELECT * FROM px)")


@query("ray_triangle_hits", f"WITH {ALL_RAYS} SELECT section_id, sample, count(*) AS n FROM cap GROUP BY 1, 2", "faces")
def ray_triangle_hits(spark, sf_dir):
    return op.stopped_rays(spark, _sections(spark, sf_dir), _chimneys(spark, sf_dir), None, LAT, LNG).select("section_id", "sample", "n")


@query("ray_ellipsoid_hits", f"WITH {ALL_RAYS} SELECT section_id, sample, count(*) AS n FROM leaf GROUP BY 1, 2", "faces")
def ray_ellipsoid_hits(spark, sf_dir):
    return op.stopped_rays(spark, _sections(spark, sf_dir), None, _trees(spark, sf_dir), LAT, LNG).select("section_id", "sample", "n")


@query("per_pixel_bake", f"""WITH {BLOCKED}, bm AS (SELECT section_id, row, col, sum(CASE WHEN d.sample IS NULL THEN beam ELSE 0 END) AS beams FROM ray LEFT JOIN dark d USING (section_id, row, col, sample) GROUP BY 1, 2, 3)
  SELECT section_id, row::INT AS row, col::INT AS col, round((sky * (1 + ny) / 2 + glo * 0.2 * (1 - ny) / 2 + coalesce(beams, 0)) / 1000, 3) + 0.0 AS kwh_m2 FROM free CROSS JOIN light LEFT JOIN bm USING (section_id, row, col)""", "faces")
def per_pixel_bake(spark, sf_dir):
    df = op.bake(spark, _sections(spark, sf_dir), _chimneys(spark, sf_dir), _trees(spark, sf_dir), LAT, LNG)
    return df.select("section_id", "row", "col", fixed("kwh_m2", 3).alias("kwh_m2"))


@query("pixel_grid_stats", f"WITH {EVEN}, bm AS (SELECT section_id, sum(beam) AS beams FROM fb GROUP BY 1), kk AS (SELECT px.section_id, (sky * (1 + ny) / 2 + glo * 0.2 * (1 - ny) / 2 + coalesce(beams, 0)) / 1000 AS k FROM px CROSS JOIN light LEFT JOIN bm USING (section_id)) SELECT section_id, count(*) AS n, round(min(k), 4) + 0.0 AS low, round(max(k), 4) + 0.0 AS high, round(avg(k), 4) + 0.0 AS mean FROM kk GROUP BY 1", "faces")
def pixel_grid_stats(spark, sf_dir):
    df = op.bake(spark, _sections(spark, sf_dir), None, None, LAT, LNG, mode="none")
    return df.groupBy("section_id").agg(F.count("*").alias("n"), fixed(F.min("kwh_m2"), 4).alias("low"), fixed(F.max("kwh_m2"), 4).alias("high"), fixed(F.avg("kwh_m2"), 4).alias("mean"))
