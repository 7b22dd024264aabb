"""Queries of the height-grid family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import grid as op
from heliogable.operators import points
from heliogable.plans.base import bridge, query
from heliogable.sources.tables import keep

# The filled grid, its empty cells from the nearest filled one.
FILLED = """o AS (SELECT scene_id, min(x) AS x0, min(z) AS z0, ceil((max(z) - min(z)) / 0.5)::INT AS rr, ceil((max(x) - min(x)) / 0.5)::INT AS cc FROM points GROUP BY 1),
  raw AS (SELECT scene_id, trunc((z - z0) / 0.5)::INT AS row, trunc((x - x0) / 0.5)::INT AS col, max(y) AS h FROM points JOIN o USING (scene_id) GROUP BY 1, 2, 3),
  cells AS (SELECT scene_id, a.r::INT AS row, b.c::INT AS col FROM o, LATERAL (SELECT unnest(range(0, o.rr + 1)) AS r) a, LATERAL (SELECT unnest(range(0, o.cc + 1)) AS c) b),
  fill AS (SELECT e.scene_id, e.row, e.col, arg_min(g.h, (((g.row - e.row) ** 2 + (g.col - e.col) ** 2) * 1000 + g.row) * 1000 + g.col) AS h FROM (SELECT * FROM cells ANTI JOIN raw USING (scene_id, row, col)) e JOIN raw g ON e.scene_id = g.scene_id GROUP BY 1, 2, 3),
  grid AS (SELECT * FROM raw UNION ALL SELECT * FROM fill)"""
INSIDE = "face AS (SELECT * FROM grid WHERE h >= 3.2 AND row % 9 > 0)"


def _grid(spark, sf_dir):
    p = bridge(spark, sf_dir, "points")
    return keep(points.fill_grid(points.full_grid(points.height_grid(p), p)).select("scene_id", "row", "col", "h"), "grid")


@query("grid_gradients", f"""WITH {FILLED}, d AS (SELECT g.*, w.h AS w, e.h AS e, n.h AS n, s.h AS s FROM grid g LEFT JOIN grid w ON w.scene_id = g.scene_id AND w.row = g.row AND w.col = g.col - 1 LEFT JOIN grid e ON e.scene_id = g.scene_id AND e.row = g.row AND e.col = g.col + 1
  LEFT JOIN grid n ON n.scene_id = g.scene_id AND n.col = g.col AND n.row = g.row - 1 LEFT JOIN grid s ON s.scene_id = g.scene_id AND s.col = g.col AND s.row = g.row + 1)
  SELECT scene_id, row, col, round(coalesce((e - w) / 2, e - h, h - w), 6) + 0.0 AS dx, round(coalesce((s - n) / 2, s - h, h - n), 6) + 0.0 AS dz FROM d""", "points")
def grid_gradients(spark, sf_dir):
    return op.gradients(_grid(spark, sf_dir)).select("scene_id", "row", "col", fixed("dx", 6).alias("dx"), fixed("dz", 6).alias("dz"))


@query("local_variance", f"WITH {FILLED} SELECT g.scene_id, g.row, g.col, round(CASE WHEN count(*) < 3 THEN 0 ELSE var_pop(n.h) END, 9) + 0.0 AS variance FROM grid g JOIN grid n ON n.scene_id = g.scene_id AND n.row BETWEEN g.row - 1 AND g.row + 1 AND n.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY 1, 2, 3", "points")
def local_variance(spark, sf_dir):
    return op.local_variance(_grid(spark, sf_dir)).select("scene_id", "row", "col", fixed("variance", 9).alias("variance"))


@query("local_roughness", f"""WITH {FILLED}, pt AS (SELECT g.scene_id, g.row, g.col, n.col::DOUBLE AS x, n.h AS y, n.row::DOUBLE AS z FROM grid g JOIN (SELECT scene_id, h, row, col, row + dr AS gr, col + dc AS gc FROM grid, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)) n ON n.scene_id = g.scene_id AND n.gr = g.row AND n.gc = g.col),
  cv AS (SELECT scene_id, row, col, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM pt GROUP BY 1, 2, 3 HAVING count(*) >= 6),
  q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM q),
  t AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 AS t FROM p)
  SELECT scene_id, row, col, round(sqrt(greatest(0, q + 2 * p * cos(t + 2 * pi() / 3))), 4) + 0.0 AS roughness FROM t""", "points")
def local_roughness(spark, sf_dir):
    return op.roughness(_grid(spark, sf_dir)).select("scene_id", "row", "col", fixed("roughness", 4).alias("roughness"))


@query("edge_dropoffs", f"""WITH {FILLED}, {INSIDE}, nb AS (SELECT f.scene_id, f.row AS fr, f.col AS fc, f.h AS fh, g.row, g.col, g.h, f.h - g.h AS fall FROM face f JOIN grid g ON g.scene_id = f.scene_id AND abs(g.row - f.row) + abs(g.col - f.col) = 1 WHERE NOT EXISTS (SELECT 1 FROM face i WHERE i.scene_id = g.scene_id AND i.row = g.row AND i.col = g.col)),
  st AS (SELECT * FROM nb WHERE fall > 0.5 QUALIFY row_number() OVER (PARTITION BY scene_id, row, col ORDER BY fr, fc) = 1), k AS (SELECT scene_id, CASE WHEN h < 1.5 THEN fr ELSE row END AS row, CASE WHEN h < 1.5 THEN fc ELSE col END AS col, CASE WHEN h < 1.5 THEN 'ground' ELSE 'roof' END AS kind FROM st
  UNION ALL SELECT scene_id, fr, fc, 'weak' FROM nb WHERE abs(fall) <= 0.5) SELECT scene_id, row, col, kind, count(*) AS n FROM k GROUP BY ALL""", "points")
def edge_dropoffs(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return op.dropoffs(grid, grid.filter((F.col("h") >= 3.2) & (F.col("row") % 9 > 0))).groupBy("scene_id", "row", "col", "kind").agg(F.count("*").alias("n"))
