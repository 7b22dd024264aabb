"""Queries of the image family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import image as op
from heliogable.plans.base import bridge, query, table

SIGNALS = "g AS (SELECT *, (compactness > 0.55 AND vertices > 8)::BIGINT + (vertices >= 4 AND confidence < 0.5)::BIGINT + (green > 0.25)::BIGINT + (texture * 2000 > 700)::BIGINT + (overlap > 0.8 AND compactness > 0.6)::BIGINT AS tree_signals FROM regions)"


def _regions(spark, sf_dir):
    return op.tree_signals(bridge(spark, sf_dir, "regions"), F.col("confidence"), F.col("overlap"))


@query("tree_signals", f"WITH {SIGNALS} SELECT region_id, tree_signals FROM g", "regions")
def tree_signals(spark, sf_dir):
    return _regions(spark, sf_dir).select("region_id", "tree_signals")


REJECT = f"""{SIGNALS}, r AS (SELECT region_id, CASE WHEN veto < 0.45 AND tree_signals >= 3 AND green > 0.35 THEN 'vegetation' WHEN veto < 0.45 AND tree_signals >= 3 AND texture * 2000 > 900 THEN 'texture' WHEN overlap < CASE WHEN veto >= 0.45 THEN 0.3 ELSE 0.5 END THEN 'roof_mask_overlap'
  WHEN area < 4 THEN 'too_small' WHEN area > 300 THEN 'too_large' WHEN aspect > 6 THEN 'aspect_ratio' WHEN compactness < 0.2 THEN 'compactness' WHEN x0 + w / 2 < 2 OR x0 + w / 2 > 46 OR z0 + h / 2 < 2 OR z0 + h / 2 > 46 THEN 'centrality' WHEN vertices < 3 THEN 'vertex_count' END AS reason FROM g)"""


@query("region_rejections", f"WITH {REJECT} SELECT region_id, reason FROM r", "regions")
def region_rejections(spark, sf_dir):
    return op.rejection(_regions(spark, sf_dir), op.make_config(), 48.0, 48.0).select("region_id", "reason")


@query("rejection_counts", f"WITH {REJECT}, k AS (SELECT unnest(['vegetation', 'texture', 'roof_mask_overlap', 'too_small', 'too_large', 'aspect_ratio', 'compactness', 'centrality', 'vertex_count']) AS reason) SELECT k.reason, count(r.reason) AS n FROM k LEFT JOIN r USING (reason) GROUP BY 1", "regions")
def rejection_counts(spark, sf_dir):
    own = region_rejections(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(r,) for r in op.REASONS], "reason string")
    return kinds.join(own, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("plane_diagnostics", "SELECT region_id, concat_ws('|', CASE WHEN area > 150 THEN 'likely_scale_error' END, CASE WHEN green > 0.2 AND veto < 0.45 THEN 'likely_tree_bleed' END, CASE WHEN overlap < 0.6 THEN 'likely_boundary_bleed' END, CASE WHEN area > w * h * 0.95 THEN 'likely_boundary_inflation' END) AS flags FROM regions", "regions")
def plane_diagnostics(spark, sf_dir):
    return op.diagnostics(bridge(spark, sf_dir, "regions")).select("region_id", "flags")


@query("plane_totals", "SELECT roof_id, count(*) AS planes, round(sum(area), 2) + 0.0 AS total, round(avg(area), 2) + 0.0 AS mean, max(area) AS largest, min(area) AS smallest FROM regions WHERE confidence >= 0.3 GROUP BY 1", "regions")
def plane_totals(spark, sf_dir):
    return bridge(spark, sf_dir, "regions").filter("confidence >= 0.3").groupBy("roof_id").agg(F.count("*").alias("planes"), fixed(F.sum("area"), 2).alias("total"), fixed(F.avg("area"), 2).alias("mean"), F.max("area").alias("largest"), F.min("area").alias("smallest"))


@query("obstruction_classify", "SELECT region_id, CASE WHEN compactness > 0.75 THEN CASE WHEN area < 1 THEN 'vent' ELSE 'pipe' END WHEN aspect < 1.5 AND area > 1 THEN 'chimney' WHEN aspect > 1.5 AND area > 0.5 THEN 'skylight' ELSE 'unknown' END AS kind, round(least(0.6, 0.3 + 0.2 * compactness), 5) + 0.0 AS confidence FROM regions WHERE area BETWEEN 0.2 AND 12", "regions")
def obstruction_classify(spark, sf_dir):
    r = bridge(spark, sf_dir, "regions").filter("area between 0.2 and 12")
    return r.select("region_id", op.obstruction_kind(F.col("area"), F.col("aspect"), F.col("compactness")).alias("kind"), fixed(F.least(F.lit(0.6), 0.3 + 0.2 * F.col("compactness")), 5).alias("confidence"))


CORNERS = "q AS (SELECT region_id, i, 10 * cos(radians((i * 360.0) / vertices)) * (1 + (region_id * (i + 3) % 7) / 10.0) AS x, 10 * sin(radians((i * 360.0) / vertices)) * (1 + (region_id * (i + 5) % 5) / 10.0) AS z, vertices FROM regions, LATERAL (SELECT unnest(range(0, vertices)) AS i) k)"
BOUNDARY = f"""{CORNERS}, e AS (SELECT a.region_id, a.i, b.x - a.x AS dx, b.z - a.z AS dz FROM q a JOIN q b ON a.region_id = b.region_id AND b.i = (a.i + 1) % a.vertices),
  l AS (SELECT *, sqrt(dx * dx + dz * dz) AS len, floor(round((degrees(atan2(dz, dx)) + 360) % 180, 6) / 15) % 12 AS bin FROM e), t AS (SELECT *, sum(len) OVER (PARTITION BY region_id) AS p FROM l),
  st AS (SELECT region_id, count(*) AS corners, sum(CASE WHEN len > p * 0.08 THEN len ELSE 0 END) / max(p) AS straight FROM t GROUP BY 1), bn AS (SELECT region_id, bin, count(*) AS n FROM l GROUP BY 1, 2), tp AS (SELECT region_id, n, row_number() OVER (PARTITION BY region_id ORDER BY n DESC) AS k FROM bn),
  co AS (SELECT region_id, sum(n) FILTER (k <= 2) / sum(n) AS concentration FROM tp GROUP BY 1)"""


@query("roof_veto_score", f"""WITH {BOUNDARY} SELECT region_id, corners, round(straight, 5) + 0.0 AS straight, round(concentration, 5) + 0.0 AS concentration, round(least(1, straight * 0.25 + CASE WHEN corners <= 6 THEN 0.2 WHEN corners <= 10 THEN 0.1 ELSE 0 END + concentration * 0.2
  + CASE WHEN compactness > 0.5 THEN 0.15 WHEN compactness > 0.3 THEN 0.08 ELSE 0 END + CASE WHEN area * 100 > 5000 THEN 0.1 WHEN area * 100 > 2000 THEN 0.05 ELSE 0 END + CASE WHEN overlap > 0.85 THEN 0.1 ELSE 0 END), 5) + 0.0 AS score FROM st JOIN co USING (region_id) JOIN regions USING (region_id)""", "regions")
def roof_veto_score(spark, sf_dir):
    r = bridge(spark, sf_dir, "regions")
    turn = F.radians(F.col("i") * 360 / F.col("vertices"))
    q = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vertices") - 1)))
    q = q.select("region_id", "i", (10 * F.cos(turn) * (1 + F.col("region_id") * (F.col("i") + 3) % 7 / 10)).alias("x"), (10 * F.sin(turn) * (1 + F.col("region_id") * (F.col("i") + 5) % 5 / 10)).alias("z"))
    df = op.boundary_scores(q).join(r.select("region_id", "compactness", (F.col("area") * 100).alias("area_px"), F.col("overlap").alias("solidity")), "region_id")
    return df.select("region_id", "corners", fixed("straight", 5).alias("straight"), fixed("concentration", 5).alias("concentration"), fixed(op.roof_veto(df), 5).alias("score"))


MASK = "mask AS (SELECT roof_id, region_id, (floor(z0) + a.i)::BIGINT AS row, (floor(x0) + b.i)::BIGINT AS col FROM regions, LATERAL (SELECT unnest(range(0, (1 + floor(h))::INT)) AS i) a, LATERAL (SELECT unnest(range(0, (1 + floor(w))::INT)) AS i) b)"


def _masks(spark, sf_dir):
    r = bridge(spark, sf_dir, "regions")
    run = lambda at, size: F.explode(F.sequence(F.floor(at), F.floor(at) + F.floor(size)))
    return r.withColumn("row", run("z0", "h")).withColumn("col", run("x0", "w")).select("roof_id", "region_id", "row", "col")


@query("overlap_matrix", f"WITH {MASK}, n AS (SELECT region_id, count(*) AS n FROM mask GROUP BY 1), s AS (SELECT a.roof_id, a.region_id AS p, b.region_id AS q, count(*) AS shared FROM mask a JOIN mask b USING (roof_id, row, col) WHERE a.region_id < b.region_id GROUP BY 1, 2, 3) SELECT roof_id, p, q, shared, round(shared / (x.n + y.n - shared), 6) + 0.0 AS iou, greatest(shared / x.n, shared / y.n) > 0.2 AS flagged FROM s JOIN n x ON x.region_id = p JOIN n y ON y.region_id = q", "regions")
def overlap_matrix(spark, sf_dir):
    return op.overlaps(_masks(spark, sf_dir)).select("roof_id", "p", "q", "shared", fixed("iou", 6).alias("iou"), "flagged")


@query("coverage_stats", f"WITH {MASK}, r AS (SELECT DISTINCT roof_id, row, col FROM mask WHERE region_id % 3 < 2), p AS (SELECT DISTINCT roof_id, row, col FROM mask WHERE region_id % 3 > 0), b AS (SELECT coalesce(r.roof_id, p.roof_id) AS roof_id, r.row AS a, p.row AS b FROM r FULL JOIN p ON r.roof_id = p.roof_id AND r.row = p.row AND r.col = p.col), c AS (SELECT roof_id, count(a) AS roof, count(b) AS planes, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS covered FROM b GROUP BY 1), s AS (SELECT *, CASE WHEN roof > 0 THEN 100 * covered / roof ELSE 0 END AS share FROM c) SELECT roof_id, roof, covered, planes - covered AS outside, round(share, 4) + 0.0 AS share, CASE WHEN share >= 70 THEN 'good' WHEN share >= 40 THEN 'partial' WHEN share >= 10 THEN 'poor' ELSE 'failed' END AS level FROM s", "regions")
def coverage_stats(spark, sf_dir):
    m = _masks(spark, sf_dir)
    pixels = lambda cond: m.filter(cond).select("roof_id", "row", "col")
    return op.coverage(pixels("region_id % 3 < 2"), pixels("region_id % 3 > 0")).select("roof_id", "roof", "covered", "outside", fixed("share", 4).alias("share"), "level")


@query("nms")
def nms(spark, sf_dir):
    return op.suppress(bridge(spark, sf_dir, "regions"), 0.15)


LINES = "li AS (SELECT region_id, roof_id, x0 AS mx, z0 AS mz, w AS length, (region_id * 17) % 180 AS angle, region_id % 2 AS kind FROM regions)"


@query("line_combine", f"WITH {LINES} SELECT region_id, roof_id FROM li WHERE kind = 0 UNION ALL SELECT region_id, roof_id FROM li o WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM li l WHERE l.kind = 0 AND l.roof_id = o.roof_id AND least(abs(o.angle - l.angle), 180 - abs(o.angle - l.angle)) <= 10 AND sqrt((o.mx - l.mx) ** 2 + (o.mz - l.mz) ** 2) < 1.5 * greatest(o.length, l.length))", "regions")
def line_combine(spark, sf_dir):
    lines = bridge(spark, sf_dir, "regions").select("region_id", "roof_id", F.col("x0").alias("mx"), F.col("z0").alias("mz"), F.col("w").alias("length"), (F.col("region_id") * 17 % 180).alias("angle"))
    return op.merge_lines(lines.filter("region_id % 2 = 0"), lines.filter("region_id % 2 = 1"), near=1.5).select("region_id", "roof_id")


@query("ridge_candidates", f"WITH {LINES} SELECT region_id, length, round(0.7 * (region_id % 100) / 100, 6) + 0.0 AS confidence FROM li WHERE length >= 3 ORDER BY length DESC, region_id LIMIT 10", "regions")
def ridge_candidates(spark, sf_dir):
    r = bridge(spark, sf_dir, "regions")
    return r.filter("w >= 3").orderBy(F.desc("w"), "region_id").limit(10).select("region_id", F.col("w").alias("length"), fixed(0.7 * (F.col("region_id") % 100) / 100, 6).alias("confidence"))


@query("shadow_mask", "WITH p AS (SELECT user_id AS roof_id, event_id AS pixel, (event_id * 31) % 256 AS v, (event_id * 57) % 160 AS s FROM events), l AS (SELECT roof_id, quantile_cont(v, 0.08) AS cut FROM p GROUP BY 1) SELECT roof_id, pixel FROM p JOIN l USING (roof_id) WHERE v < cut AND s < 80")
def shadow_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("roof_id"), F.col("event_id").alias("pixel"), (F.col("event_id") * 31 % 256).alias("v"), (F.col("event_id") * 57 % 160).alias("s"))
    return op.dark_pixels(e).select("roof_id", "pixel")


@query("diagnostics_hash", "SELECT region_id, substr(sha256('{\"area\":' || (region_id * 37 % 6000) || ',\"id\":' || region_id || ',\"roof\":' || roof_id || '}'), 1, 16) AS hash FROM regions", "regions")
def diagnostics_hash(spark, sf_dir):
    r = bridge(spark, sf_dir, "regions")
    text = F.to_json(F.struct((F.col("region_id") * 37 % 6000).alias("area"), F.col("region_id").alias("id"), F.col("roof_id").alias("roof")))
    return r.select("region_id", F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


@query("material_hint", "SELECT event_id, CASE WHEN s < 40 THEN CASE WHEN v < 90 THEN 'asphalt_shingle' ELSE 'metal' END WHEN h < 15 OR h > 165 THEN 'clay_tile' WHEN h BETWEEN 15 AND 30 THEN 'wood_shake' ELSE 'unknown' END AS material FROM (SELECT event_id, event_id * 7 % 180 AS h, event_id * 11 % 256 AS s, event_id * 13 % 256 AS v FROM events) AS x")
def material_hint(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", op.material(i * 7 % 180, i * 11 % 256, i * 13 % 256).alias("material"))
