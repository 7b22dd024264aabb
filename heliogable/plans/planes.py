"""Queries of the planes and labels family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed, num
from heliogable.operators import planes as op
from heliogable.operators.points import nearest_neighbours
from heliogable.plans.base import bridge, query
from heliogable.plans.points import NEAR

PLANES = "pl AS (SELECT *, CASE WHEN abs(x) <= 6 AND abs(z) <= 5 THEN CASE WHEN z >= 0 THEN 1 ELSE 0 END ELSE -1 END::BIGINT AS plane FROM points)"
COV = "cv AS (SELECT scene_id, plane, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pl WHERE plane >= 0 GROUP BY 1, 2)"


def _points(spark, sf_dir):
    inside = (F.abs("x") <= 6) & (F.abs("z") <= 5)
    return bridge(spark, sf_dir, "points").withColumn("plane", F.when(inside, F.when(F.col("z") >= 0, 1).otherwise(0)).otherwise(-1).cast("long"))


# The smallest eigenvalue of the covariances by its cubic, the normal as a cross product of two rows.
FIT = f"""{COV}, fq AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv WHERE n >= 3), fp AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM fq),
  ft AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 AS t FROM fp),
  fe AS (SELECT *, q + 2 * p * cos(t + 2 * pi() / 3) AS e FROM ft), fn AS (SELECT *, xy * (zz - e) - xz * yz AS n0, xz * xz - (xx - e) * (zz - e) AS n1, (xx - e) * yz - xy * xz AS n2 FROM fe),
  fit AS (SELECT scene_id, plane, n, e, sign(n1) * n0 / sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS nx, abs(n1) / sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS ny, sign(n1) * n2 / sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS nz, mx, my, mz FROM fn)"""


@query("plane_fit", f"WITH {PLANES}, {FIT} SELECT scene_id, plane, n, round(degrees(acos(ny)), 5) + 0.0 AS pitch, round(sqrt(greatest(0, e)), 5) + 0.0 AS residual FROM fit", "points")
def plane_fit(spark, sf_dir):
    return op.fit(_points(spark, sf_dir).filter("plane >= 0")).select("scene_id", "plane", "n", fixed("pitch", 5).alias("pitch"), fixed("residual", 5).alias("residual"))


@query("ransac_plane")
def ransac_plane(spark, sf_dir):
    return op.ransac(bridge(spark, sf_dir, "points")).select("scene_id", "inliers", *[fixed(c, 5).alias(c) for c in ("nx", "ny", "nz")])


NINE = "(SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz)"
CORE = f"""c9 AS (SELECT scene_id, pid, x, z, floor(x / 2) + dx AS cx, floor(z / 2) + dz AS cz FROM points, {NINE}),
  pr AS (SELECT a.scene_id, a.pid AS a, b.pid AS b FROM points a JOIN c9 b ON a.scene_id = b.scene_id AND floor(a.x / 2) = cx AND floor(a.z / 2) = cz WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 2), nb AS (SELECT scene_id, a AS pid, count(*) AS near FROM pr GROUP BY 1, 2)"""


def components_sql(nodes: str, links: str, name: str) -> str:
    """A recursive relation (scene_id, pid, low): smallest label that reaches a node over directed links (scene_id, a, b)."""
    return f"""{name}(scene_id, pid, low) USING KEY (scene_id, pid) AS (SELECT scene_id, pid, pid FROM {nodes}
    UNION SELECT k.scene_id, k.b, min(t.low) FROM {name} t JOIN {links} k ON k.scene_id = t.scene_id AND k.a = t.pid JOIN recurring.{name} r ON r.scene_id = k.scene_id AND r.pid = k.b WHERE t.low < r.low GROUP BY 1, 2)"""


@query("dbscan_core", f"WITH {CORE} SELECT scene_id, pid, near, near >= 20 AS core FROM nb", "points")
def dbscan_core(spark, sf_dir):
    return op.core_points(bridge(spark, sf_dir, "points")).select("scene_id", "pid", "near", "core")


@query("dbscan_xz", f"""WITH RECURSIVE {CORE}, co AS (SELECT scene_id, pid FROM nb WHERE near >= 20), kl AS (SELECT pr.* FROM pr JOIN co u ON u.scene_id = pr.scene_id AND u.pid = a JOIN co v ON v.scene_id = pr.scene_id AND v.pid = b WHERE a <> b), {components_sql("co", "kl", "lb")},
  bd AS (SELECT pr.scene_id, a AS pid, min(lb.low) AS reach FROM pr JOIN lb ON lb.scene_id = pr.scene_id AND lb.pid = b GROUP BY 1, 2), sc AS (SELECT scene_id, min(pid) AS first, bool_or(pid IN (SELECT pid FROM co)) AS any_core FROM points GROUP BY 1)
  SELECT p.scene_id, p.pid, CASE WHEN any_core THEN coalesce(lb.low, bd.reach) ELSE first END AS cluster FROM points p JOIN sc USING (scene_id) LEFT JOIN lb USING (scene_id, pid) LEFT JOIN bd USING (scene_id, pid)""", "points")
def dbscan_xz(spark, sf_dir):
    return op.dbscan(bridge(spark, sf_dir, "points").select("scene_id", "pid", "x", "z")).select("scene_id", "pid", "cluster")


@query("coplanar_merge")
def coplanar_merge(spark, sf_dir):
    strips = _points(spark, sf_dir).filter("plane >= 0").withColumn("plane", (F.col("plane") * 100 + F.floor(F.col("x") / 3) + 50).cast("long"))
    return op.merge_coplanar(op.fit(strips))


@query("density_prefilter", f"""WITH RECURSIVE {NEAR}, rr AS (SELECT p.*, greatest(0.3, 2 * CASE WHEN c > 2 THEN nn ELSE 0.15 END) AS r, c FROM points p JOIN (SELECT scene_id, count(*) AS c FROM points GROUP BY 1) USING (scene_id) LEFT JOIN (SELECT scene_id, quantile_cont(sqrt(d2), 0.5) AS nn FROM near WHERE rank = 1 GROUP BY 1) USING (scene_id)),
  r9 AS (SELECT scene_id, pid, x, y, z, floor(x / r) + dx AS cx, floor(z / r) + dz AS cz FROM rr, {NINE}), ok AS (SELECT a.scene_id, a.pid FROM rr a JOIN r9 b ON a.scene_id = b.scene_id AND floor(a.x / r) = b.cx AND floor(a.z / r) = b.cz WHERE c >= 5 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= r GROUP BY 1, 2 HAVING count(*) >= 3),
  kp AS (SELECT rr.* FROM rr JOIN ok USING (scene_id, pid)), k9 AS (SELECT scene_id, pid, x, z, floor(x / (1.5 * r)) + dx AS cx, floor(z / (1.5 * r)) + dz AS cz FROM kp, {NINE}),
  kl AS (SELECT a.scene_id, a.pid AS a, b.pid AS b FROM kp a JOIN k9 b ON a.scene_id = b.scene_id AND floor(a.x / (1.5 * r)) = b.cx AND floor(a.z / (1.5 * r)) = b.cz AND a.pid <> b.pid WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 1.5 * r), {components_sql("kp", "kl", "lb")},
  sz AS (SELECT scene_id, pid, count(*) OVER (PARTITION BY scene_id, low) AS size, count(*) OVER (PARTITION BY scene_id) AS kept FROM lb) SELECT scene_id, pid FROM sz WHERE kept <= 10 OR size >= 5 UNION ALL SELECT scene_id, pid FROM rr WHERE c < 5""", "points")
def density_prefilter(spark, sf_dir):
    p = bridge(spark, sf_dir, "points")
    near = nearest_neighbours(p, 1).groupBy("scene_id").agg(F.when(F.count("*") > 2, F.percentile("d", 0.5)).otherwise(num(0.15)).alias("nn"))
    return op.dense(p, near).select("scene_id", "pid")


def _edges(spark, sf_dir):
    lines = [(0, "ridge", -6.0, 0.0, 6.0, 0.0), (1, "hip", -6.0, -5.0, -1.0, 0.0), (2, "valley", 6.0, 5.0, 1.0, 0.0), (3, "eave", -6.0, 5.0, 6.0, 5.0), (4, "ridge", 0.0, 0.0, 0.05, 0.0)]
    return bridge(spark, sf_dir, "points").select("scene_id").distinct().join(F.broadcast(spark.createDataFrame(lines, "edge_id int, edge_type string, x0 double, z0 double, x1 double, z1 double")))


BANDS = """ed AS (SELECT * FROM (VALUES (0, 'ridge', -6.0, 0.0, 6.0, 0.0), (1, 'hip', -6.0, -5.0, -1.0, 0.0), (2, 'valley', 6.0, 5.0, 1.0, 0.0), (3, 'eave', -6.0, 5.0, 6.0, 5.0)) AS v(edge_id, kind, x0, z0, x1, z1)),
  tt AS (SELECT *, least(1, greatest(0, ((x - x0) * (x1 - x0) + (z - z0) * (z1 - z0)) / ((x1 - x0) ** 2 + (z1 - z0) ** 2))) AS t FROM pl, ed WHERE plane >= 0), gp AS (SELECT *, round(sqrt((x - x0 - t * (x1 - x0)) ** 2 + (z - z0 - t * (z1 - z0)) ** 2), 9) AS gap FROM tt),
  r5 AS (SELECT scene_id, pid, plane, x, z, floor(x) + dx AS cx, floor(z) + dz AS cz FROM pl, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz) WHERE plane >= 0),
  tw AS (SELECT a.scene_id, a.pid FROM pl a JOIN r5 b ON a.scene_id = b.scene_id AND floor(a.x) = cx AND floor(a.z) = cz WHERE a.plane >= 0 AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 0.5 GROUP BY 1, 2 HAVING count(DISTINCT b.plane) >= 2),
  lb AS (SELECT scene_id, pid, CASE WHEN kind <> 'valley' AND tw.pid IS NULL THEN NULL WHEN kind IN ('ridge', 'hip') AND gap < 0.15 THEN 'ridge_dot' WHEN kind IN ('ridge', 'hip') AND gap < 0.3 THEN 'near_ridge' WHEN kind = 'valley' AND gap < 0.15 THEN 'valley_dot' END AS label, edge_id FROM gp LEFT JOIN tw USING (scene_id, pid)),
  bands AS (SELECT scene_id, pid, label FROM lb WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene_id, pid ORDER BY edge_id) = 1)"""


def _labels(spark, sf_dir):
    p = _points(spark, sf_dir)
    bands = op.band_labels(p.filter("plane >= 0"), _edges(spark, sf_dir))
    return p.join(bands, ["scene_id", "pid"], "left").withColumn("label", F.coalesce("label", F.when(F.col("plane") >= 0, F.lit("roof")).when(F.col("pid") % 11 == 0, F.lit("unsure")).otherwise(F.lit("ground"))))


ALL = f"{PLANES}, {BANDS}, labels AS (SELECT pl.*, coalesce(bands.label, CASE WHEN plane >= 0 THEN 'roof' WHEN pid % 11 = 0 THEN 'unsure' ELSE 'ground' END) AS label FROM pl LEFT JOIN bands USING (scene_id, pid))"


@query("ridge_band_labels", f"WITH {PLANES}, {BANDS} SELECT scene_id, pid, label FROM bands", "points")
def ridge_band_labels(spark, sf_dir):
    return op.band_labels(_points(spark, sf_dir).filter("plane >= 0"), _edges(spark, sf_dir))


@query("label_histogram", f"WITH {ALL}, k AS (SELECT unnest(['unsure', 'ground', 'roof', 'ridge_dot', 'near_ridge', 'valley_dot', 'eave_dot', 'tree']) AS label) SELECT k.label, count(labels.label) AS n FROM k LEFT JOIN labels USING (label) GROUP BY 1", "points")
def label_histogram(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in ("unsure", "ground", "roof", "ridge_dot", "near_ridge", "valley_dot", "eave_dot", "tree")], "label string")
    own = _labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return kinds.join(own, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("label_vote_grid", f"WITH {ALL}, c AS (SELECT scene_id, floor(z)::BIGINT AS row, floor(x)::BIGINT AS col, label, count(*) AS n, min(pid) AS f FROM labels WHERE label <> 'unsure' GROUP BY 1, 2, 3, 4) SELECT scene_id, row, col, label, n FROM c QUALIFY row_number() OVER (PARTITION BY scene_id, row, col ORDER BY CASE label WHEN 'ground' THEN 1 WHEN 'roof' THEN 2 ELSE 3 END DESC, n DESC, f) = 1", "points")
def label_vote_grid(spark, sf_dir):
    return op.vote_grid(_labels(spark, sf_dir))


ROUNDS = ", ".join(
    f"""v{k} AS (SELECT e.scene_id, e.row, e.col, n.label, count(*) AS n, min((n.row - e.row + 1) * 3 + n.col - e.col + 1) AS pos, n.label IN ('roof', 'ridge_dot', 'near_ridge') AS rf FROM g{k} e JOIN g{k} n ON e.label IS NULL AND n.label IS NOT NULL AND n.scene_id = e.scene_id AND abs(n.row - e.row) <= 1 AND abs(n.col - e.col) <= 1 GROUP BY ALL),
  w{k} AS (SELECT *, bool_or(rf) OVER c AND bool_or(label = 'tree') OVER c AS mixed FROM v{k} WINDOW c AS (PARTITION BY scene_id, row, col)), x{k} AS (SELECT * FROM w{k} WHERE NOT (mixed AND NOT rf) QUALIFY row_number() OVER (PARTITION BY scene_id, row, col ORDER BY n DESC, pos) = 1),
  g{k + 1} AS (SELECT g.scene_id, g.row, g.col, coalesce(g.label, x{k}.label) AS label FROM g{k} g LEFT JOIN x{k} USING (scene_id, row, col))"""
    for k in range(3)
)


@query("grid_fill_rounds", f"""WITH {ALL}, c AS (SELECT scene_id, floor(z)::BIGINT AS row, floor(x)::BIGINT AS col, label, count(*) AS n, min(pid) AS f FROM labels WHERE label <> 'unsure' GROUP BY 1, 2, 3, 4),
  k AS (SELECT scene_id, row, col, label FROM c QUALIFY row_number() OVER (PARTITION BY scene_id, row, col ORDER BY CASE label WHEN 'ground' THEN 1 WHEN 'roof' THEN 2 ELSE 3 END DESC, n DESC, f) = 1),
  g0 AS (SELECT scene_id, row, col, CASE WHEN abs(row * 7 + col * 3) % 5 < 4 THEN NULL WHEN label = 'ground' AND abs(col) % 4 = 1 THEN 'tree' ELSE label END AS label FROM k), {ROUNDS} SELECT scene_id, row, col, label FROM g3""", "points")
def grid_fill_rounds(spark, sf_dir):
    cells = op.vote_grid(_labels(spark, sf_dir))
    holes = F.when(F.abs(F.col("row") * 7 + F.col("col") * 3) % 5 < 4, None).when((F.col("label") == "ground") & (F.abs("col") % 4 == 1), F.lit("tree")).otherwise(F.col("label"))
    return op.fill_labels(cells.select("scene_id", "row", "col", holes.alias("label")))


@query("eave_labels", f"WITH {PLANES}, nr AS (SELECT * FROM pl WHERE abs(x) <= 7.5 AND abs(z) <= 6.5) SELECT DISTINCT a.scene_id, a.pid FROM nr a JOIN nr b ON a.scene_id = b.scene_id AND a.plane >= 0 AND b.plane = -1 WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 1", "points")
def eave_labels(spark, sf_dir):
    return op.eaves(_points(spark, sf_dir))


@query("ridge_pca_line", f"WITH {ALL}, r AS (SELECT * FROM labels WHERE label = 'ridge_dot'), m AS (SELECT scene_id, count(*) AS n, avg(x) AS mx, avg(z) AS mz, atan2(2 * covar_pop(x, z), covar_pop(x, x) - covar_pop(z, z)) / 2 AS a FROM r GROUP BY 1 HAVING count(*) >= 3) SELECT scene_id, any_value(n) AS n, round(((degrees(any_value(a)) % 180) + 180) % 180, 4) + 0.0 AS degrees, round(max((x - mx) * cos(a) + (z - mz) * sin(a)) - min((x - mx) * cos(a) + (z - mz) * sin(a)), 5) + 0.0 AS length FROM r JOIN m USING (scene_id) GROUP BY 1", "points")
def ridge_pca_line(spark, sf_dir):
    return op.ridge_line(_labels(spark, sf_dir).filter("label = 'ridge_dot'")).select("scene_id", "n", fixed("degrees", 4).alias("degrees"), fixed("length", 5).alias("length"))


@query("canopy_audit", f"""WITH {PLANES}, {FIT}, dd AS (SELECT scene_id, plane, stddev_pop((x - mx) * nx + (y - my) * ny + (z - mz) * nz) AS spread, max(y) - min(y) AS extent, avg(CASE WHEN abs((x - mx) * nx + (y - my) * ny + (z - mz) * nz) > 0.25 THEN 1.0 ELSE 0 END) AS off FROM pl JOIN fit USING (scene_id, plane) GROUP BY 1, 2)
  SELECT scene_id, plane, round(spread, 5) + 0.0 AS spread, round(extent, 6) + 0.0 AS extent, round(spread, 9) > 0.25 AND extent > 1.2 AND round(off, 9) > 0.4 AS is_canopy FROM dd""", "points")
def canopy_audit(spark, sf_dir):
    p = _points(spark, sf_dir).filter("plane >= 0")
    return op.canopy(p, op.fit(p)).select("scene_id", "plane", fixed("spread", 5).alias("spread"), fixed("extent", 6).alias("extent"), "is_canopy")
