"""Queries of the roof-graph family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed, num
from heliogable.operators import graph as op
from heliogable.plans.base import bridge, query

FULL = """f AS (SELECT *, (x1 - x0) * (z1 - z0) AS area, (x0 + x1) / 2 AS cx, (z0 + z1) / 2 AS cz, x1 - x0 AS width, z1 - z0 AS depth, pitch < 5 AND least(x1 - x0, z1 - z0) >= 2 AS is_flat, confidence < 0.6 AS needs_review,
  sin(radians(pitch)) * sin(radians(azimuth)) AS a, cos(radians(pitch)) AS b, sin(radians(pitch)) * cos(radians(azimuth)) AS c FROM faces),
  g AS (SELECT *, -(a * cx + b * (height + elevation) / 2 + c * cz) AS d FROM f)"""
ADJACENT = """v AS (SELECT scene_id, face_id, 0 AS i, x0 AS x, z0 AS z FROM faces UNION ALL SELECT scene_id, face_id, 1, x1, z0 FROM faces UNION ALL SELECT scene_id, face_id, 2, x1, z1 FROM faces UNION ALL SELECT scene_id, face_id, 3, x0, z1 FROM faces),
  m AS (SELECT a.scene_id, a.face_id AS p, b.face_id AS q, a.i, b.i AS j, (a.x + b.x) / 2 AS x, (a.z + b.z) / 2 AS z FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.face_id < b.face_id WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < 1),
  adj AS (SELECT s.scene_id, s.p, s.q, s.x AS x0, s.z AS z0, t.x AS x1, t.z AS z1, sqrt((s.x - t.x) ** 2 + (s.z - t.z) ** 2) AS length FROM m s JOIN m t ON s.scene_id = t.scene_id AND s.p = t.p AND s.q = t.q AND (s.i, s.j) < (t.i, t.j)
          WHERE sqrt((s.x - t.x) ** 2 + (s.z - t.z) ** 2) >= 0.5 QUALIFY row_number() OVER (PARTITION BY s.scene_id, s.p, s.q ORDER BY sqrt((s.x - t.x) ** 2 + (s.z - t.z) ** 2) DESC, s.i, s.j, t.i, t.j) = 1)"""
EDGES = f"""{FULL}, {ADJACENT},
  e0 AS (SELECT e.*, p.a AS pa, p.b AS pb, p.c AS pc, q.a AS qa, q.b AS qb, q.c AS qc, p.cx AS pcx, p.cz AS pcz, q.cx AS qcx, q.cz AS qcz, p.is_flat AS pf, q.is_flat AS qf, p.elevation AS pe, q.elevation AS qe, (p.height + p.elevation + q.height + q.elevation) / 4 AS lvl,
         -(p.a * e.x0 + p.c * e.z0 + p.d) / p.b AS y0, -(p.a * e.x1 + p.c * e.z1 + p.d) / p.b AS y1, least(p.confidence, q.confidence) AS confidence, p.needs_review OR q.needs_review AS needs_review FROM adj e JOIN g p ON e.scene_id = p.scene_id AND e.p = p.face_id JOIN g q ON e.scene_id = q.scene_id AND e.q = q.face_id),
  e1 AS (SELECT *, degrees(acos(abs(greatest(-1, least(1, pa * qa + pb * qb + pc * qc))))) AS angle, (y0 + y1) / 2 AS ey, sqrt(pa * pa + pc * pc) AS pn, sqrt(qa * qa + qc * qc) AS qn, (x0 + x1) / 2 AS mx, (z0 + z1) / 2 AS mz FROM e0),
  e2 AS (SELECT *, CASE WHEN pn > 1e-6 AND qn > 1e-6 THEN degrees(acos(least(1, abs(pa * qa + pc * qc) / (pn * qn)))) ELSE 0 END AS facing, (pn <= 1e-6 OR (pcx - mx) * pa + (pcz - mz) * pc > 0) AND (qn <= 1e-6 OR (qcx - mx) * qa + (qcz - mz) * qc > 0) AS convex FROM e1),
  edges AS (SELECT *, CASE WHEN angle < 10 THEN 'step_flash' WHEN (pf AND ey < pe + 0.3) OR (qf AND ey < qe + 0.3) THEN 'step_flash' WHEN convex AND ey > lvl + 0.3 THEN CASE WHEN facing > 45 THEN 'hip' ELSE 'ridge' END
            WHEN NOT convex AND ey < lvl - 0.3 THEN 'valley' WHEN convex THEN CASE WHEN facing > 30 THEN 'hip' ELSE 'ridge' END WHEN ey < lvl - 0.1 THEN 'valley' ELSE 'step_flash' END AS edge_type FROM e2)"""
BOUNDARY = f"""{EDGES}, sides AS (SELECT g.*, s.i, CASE s.i WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS sx, CASE s.i WHEN 0 THEN z0 WHEN 1 THEN z0 WHEN 2 THEN z1 ELSE z1 END AS sz,
    CASE s.i WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS tx, CASE s.i WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z1 ELSE z0 END AS tz FROM g, (SELECT unnest([0, 1, 2, 3]) AS i) s),
  h AS (SELECT *, -(a * sx + c * sz + d) / b AS sy, -(a * tx + c * tz + d) / b AS ty FROM sides s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.scene_id = s.scene_id AND s.face_id IN (e.p, e.q) AND sqrt(((s.sx + s.tx) / 2 - (e.x0 + e.x1) / 2) ** 2 + ((s.sz + s.tz) / 2 - (e.z0 + e.z1) / 2) ** 2) < 1.5)),
  boundary AS (SELECT *, sqrt((sx - tx) ** 2 + (sy - ty) ** 2 + (sz - tz) ** 2) AS len, CASE WHEN (sy + ty) / 2 < elevation + 0.5 THEN 'eave' ELSE 'rake' END AS kind FROM h)"""


def _faces(spark, sf_dir):
    f = bridge(spark, sf_dir, "faces")
    return op.complete(f.select("*", F.array("x0", "x1", "x1", "x0").alias("xs"), F.array("z0", "z0", "z1", "z1").alias("zs")))


def _edges(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    return faces, op.shared_edges(op.adjacency(faces), faces)


@query("plane_attributes", f"WITH {FULL} SELECT face_id, round(area, 4) + 0.0 AS area, is_flat, CASE WHEN area < 5 AND elevation > 2 THEN 'dormer' WHEN area < 15 AND height < 3 THEN 'porch' WHEN area < 30 AND elevation < 1.5 THEN 'garage' ELSE 'main' END AS plane_type, round((540 - azimuth) % 360, 4) + 0.0 AS compass, round(d, 5) + 0.0 AS d FROM g", "faces")
def plane_attributes(spark, sf_dir):
    return _faces(spark, sf_dir).select("face_id", fixed("area", 4).alias("area"), "is_flat", "plane_type", fixed(op.compass(F.col("azimuth")), 4).alias("compass"), fixed("d", 5).alias("d"))


@query("plane_adjacency", f"WITH {ADJACENT} SELECT scene_id, p, q, round(x0, 5) + 0.0 AS x0, round(z0, 5) + 0.0 AS z0, round(x1, 5) + 0.0 AS x1, round(z1, 5) + 0.0 AS z1, round(length, 5) + 0.0 AS length FROM adj", "faces")
def plane_adjacency(spark, sf_dir):
    return op.adjacency(_faces(spark, sf_dir)).select("scene_id", "p", "q", *[fixed(c, 5).alias(c) for c in ("x0", "z0", "x1", "z1", "length")])


@query("edge_classification", f"WITH {EDGES} SELECT scene_id, p, q, edge_type, round(y0, 5) + 0.0 AS y0, round(y1, 5) + 0.0 AS y1, round(confidence, 5) + 0.0 AS confidence, needs_review FROM edges", "faces")
def edge_classification(spark, sf_dir):
    return _edges(spark, sf_dir)[1].select("scene_id", "p", "q", "edge_type", *[fixed(c, 5).alias(c) for c in ("y0", "y1", "confidence")], "needs_review")


@query("boundary_edges", f"WITH {BOUNDARY} SELECT scene_id, face_id, i, kind AS edge_type, round(len, 5) + 0.0 AS length, round(confidence * 0.9, 5) + 0.0 AS confidence FROM boundary WHERE len >= 0.2", "faces")
def boundary_edges(spark, sf_dir):
    return op.boundary_edges(*_edges(spark, sf_dir)).select("scene_id", "face_id", "i", "edge_type", fixed("length", 5).alias("length"), fixed("confidence", 5).alias("confidence"))


@query("intersections", f"""WITH {BOUNDARY}, all_edges AS (SELECT scene_id, p * 100000 + q AS id, x0, y0, z0, x1, y1, z1 FROM edges UNION ALL SELECT scene_id, -(face_id * 4 + i) - 1, sx, sy, sz, tx, ty, tz FROM boundary WHERE len >= 0.2),
  ends AS (SELECT scene_id, id, x0 AS x, y0 AS y, z0 AS z FROM all_edges UNION ALL SELECT scene_id, id, x1, y1, z1 FROM all_edges), k AS (SELECT scene_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, count(DISTINCT id) AS edges FROM ends GROUP BY scene_id, round_even(round(x, 6), 1), round_even(round(y, 6), 1), round_even(round(z, 6), 1))
  SELECT scene_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, n, edges, CASE WHEN edges >= 3 OR round(y, 3) > 2 THEN 'peak' ELSE 'corner' END AS kind FROM k WHERE n >= 2""", "faces")
def intersections(spark, sf_dir):
    faces, edges = _edges(spark, sf_dir)
    shared = edges.select("scene_id", (F.col("p") * 100000 + F.col("q")).alias("edge_id"), "x0", "y0", "z0", "x1", "y1", "z1")
    free = op.boundary_edges(faces, edges).select("scene_id", (-(F.col("face_id") * 4 + F.col("i")) - 1).alias("edge_id"), "x0", "y0", "z0", "x1", "y1", "z1")
    return op.intersections(shared.union(free)).select("scene_id", *[fixed(c, 3).alias(c) for c in "xyz"], "n", "edges", "kind")


COMPONENTS = f"""WITH RECURSIVE {ADJACENT}, l AS (SELECT scene_id, p AS a, q AS b FROM adj UNION SELECT scene_id, q, p FROM adj), r AS (SELECT scene_id, face_id AS node, face_id AS seen FROM faces UNION SELECT r.scene_id, r.node, l.b FROM r JOIN l ON r.scene_id = l.scene_id AND r.seen = l.a),
  labels AS (SELECT scene_id, node, min(seen) AS label FROM r GROUP BY 1, 2)"""


def _labels(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    return faces, op.components(faces.select("scene_id", F.col("face_id").alias("node")), op.adjacency(faces))


@query("connected_components", f"{COMPONENTS} SELECT scene_id, node, label FROM labels", "faces")
def connected_components(spark, sf_dir):
    return _labels(spark, sf_dir)[1]


@query("lower_roof_labels", f"""{COMPONENTS}, {EDGES.replace(ADJACENT + ",", "").replace(FULL + ", ", FULL + ",")}, cp AS (SELECT g.scene_id, g.face_id, label, area, height FROM g JOIN labels ON labels.scene_id = g.scene_id AND labels.node = g.face_id),
  tp AS (SELECT scene_id, label, face_id AS largest, height AS level FROM cp QUALIFY row_number() OVER (PARTITION BY scene_id, label ORDER BY area DESC, face_id) = 1)
  SELECT cp.scene_id, cp.face_id, largest FROM cp JOIN tp USING (scene_id, label) WHERE cp.face_id <> largest AND round(level - cp.height, 9) > 1.5 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.scene_id = cp.scene_id AND edge_type IN ('ridge', 'hip') AND ((e.p = cp.face_id AND e.q = largest) OR (e.q = cp.face_id AND e.p = largest)))""", "faces")
def lower_roof_labels(spark, sf_dir):
    faces, labels = _labels(spark, sf_dir)
    return op.lower_roofs(faces, labels, _edges(spark, sf_dir)[1])


@query("obstructions", f"""{COMPONENTS}, {FULL}, one AS (SELECT scene_id, label FROM labels GROUP BY 1, 2 HAVING count(*) = 1), o AS (SELECT g.*, greatest(width, depth) / greatest(least(width, depth), 0.01) AS aspect FROM g JOIN one ON g.scene_id = one.scene_id AND g.face_id = one.label WHERE area <= 14)
  SELECT scene_id, face_id, CASE WHEN area - 10 < 0.3 THEN 'pipe' WHEN area - 10 < 1 AND aspect < 2 THEN 'vent' WHEN aspect < 2 THEN 'chimney' WHEN is_flat AND area - 10 > 1 THEN 'skylight' ELSE 'unknown' END AS obstruction_type, round(aspect, 5) AS aspect, round(confidence * 0.7, 5) AS confidence FROM o""", "faces")
def obstructions(spark, sf_dir):
    faces, labels = _labels(spark, sf_dir)
    # The street's lots are large: sizes count from 10 m2.
    return op.obstructions(faces.withColumn("area", F.col("area") - 10), labels).select("scene_id", "face_id", "obstruction_type", fixed("aspect", 5).alias("aspect"), fixed("confidence", 5).alias("confidence"))


@query("dormers", f"""WITH {FULL}, {ADJACENT}, n AS (SELECT scene_id, p AS face_id, q AS other FROM adj UNION ALL SELECT scene_id, q, p FROM adj), s AS (SELECT scene_id, face_id, x0, x1, z0, z1, area / 4 AS area, cx, cz, width, depth, pitch, azimuth, height, elevation, confidence, sin(radians(azimuth)) AS fx, cos(radians(azimuth)) AS fz FROM g WHERE face_id % 3 = 0
    UNION ALL SELECT scene_id, face_id, x0, x1, z0, z1, area, cx, cz, width, depth, pitch, azimuth, height, elevation, confidence, sin(radians(azimuth)), cos(radians(azimuth)) FROM g WHERE face_id % 3 > 0),
  d AS (SELECT s.*, n.other AS parent_id, o.x0 AS ox0, o.x1 AS ox1, o.z0 AS oz0, o.z1 AS oz1 FROM s JOIN n USING (scene_id, face_id) JOIN s o ON o.scene_id = s.scene_id AND o.face_id = n.other WHERE s.area <= 10 AND s.elevation >= 1 AND s.width >= 0.3 AND s.depth >= 0.3 AND o.area > 2 * s.area QUALIFY row_number() OVER (PARTITION BY s.scene_id, s.face_id ORDER BY n.other) = 1),
  e AS (SELECT *, greatest(ox0 * fx + oz0 * fz, ox1 * fx + oz0 * fz, ox1 * fx + oz1 * fz, ox0 * fx + oz1 * fz) - (cx * fx + cz * fz) AS front, (cx * fx + cz * fz) - least(x0 * fx + z0 * fz, x1 * fx + z0 * fz, x1 * fx + z1 * fz, x0 * fx + z1 * fz) AS back FROM d),
  h AS (SELECT *, CASE WHEN front <= 0 THEN depth / 2 ELSE front END AS f2, CASE WHEN back <= 0 THEN depth / 2 ELSE back END AS b2 FROM e)
  SELECT scene_id, face_id, parent_id, CASE WHEN pitch > 20 THEN 'gable' WHEN pitch > 5 THEN 'hip' ELSE 'shed' END AS dormer_type, round(f2 + b2, 4) + 0.0 AS depth, round(cx - fx * b2, 4) + 0.0 AS peak_x, round(elevation + b2 * tan(radians(pitch)), 4) + 0.0 AS peak_y, round(cz - fz * b2, 4) + 0.0 AS peak_z FROM h""", "faces")
def dormers(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    edges = op.adjacency(faces)
    small = F.when(F.col("face_id") % 3 == 0, F.col("area") / 4).otherwise(F.col("area"))
    df = op.dormers(faces.withColumn("area", small), edges)
    peak = F.get("outline", F.lit(3))
    return df.select("scene_id", "face_id", "parent_id", "dormer_type", fixed("depth", 4).alias("depth"), *[fixed(peak[c], 4).alias(f"peak_{c}") for c in "xyz"])


SCORES = f"""{EDGES}, dg AS (SELECT scene_id, face_id, count(*) AS n FROM (SELECT scene_id, p AS face_id FROM adj UNION ALL SELECT scene_id, q FROM adj) GROUP BY 1, 2),
  ps AS (SELECT scene_id, face_id, least(1, confidence + least(0.1, coalesce(n, 0) * 0.03)) * CASE WHEN area < 3 THEN 0.85 ELSE 1 END * CASE WHEN is_flat AND area < 10 THEN 0.9 ELSE 1 END AS score FROM g LEFT JOIN dg USING (scene_id, face_id)),
  es AS (SELECT scene_id, CASE WHEN length > 3 THEN least(1, confidence + 0.05) WHEN length < 0.5 THEN confidence * 0.8 ELSE confidence END AS score FROM edges)"""


@query("confidence_scores", f"WITH {SCORES} SELECT scene_id, face_id, round(score, 6) + 0.0 AS score, round(score, 9) < 0.6 AS review FROM ps", "faces")
def confidence_scores(spark, sf_dir):
    return op.plane_scores(*_edges(spark, sf_dir)).select("scene_id", "face_id", fixed("score", 6).alias("score"), "review")


@query("overall_confidence", f"WITH {SCORES}, u AS (SELECT scene_id, 2.0 AS w, score FROM ps UNION ALL SELECT scene_id, 1.0, score FROM es) SELECT scene_id, round(greatest(0, least(1, sum(w * score) / sum(w) * (1 - 0.3 * count(*) FILTER (round(score, 9) < 0.6) / count(*)))), 5) + 0.0 AS overall FROM u GROUP BY 1", "faces")
def overall_confidence(spark, sf_dir):
    faces, edges = _edges(spark, sf_dir)
    return op.overall(op.plane_scores(faces, edges), op.edge_scores(edges)).select("scene_id", fixed("overall", 5).alias("overall"))


CONTOURS = "o AS (SELECT scene_id, face_id + 1000000 AS contour_id, x0 + (face_id % 7) * 0.4 AS x0, x1 + (face_id % 5) * 0.3 AS x1, z0 - (face_id % 3) * 0.5 AS z0, z1 - (face_id % 4) * 0.9 AS z1, confidence FROM faces)"
FUSED = f"""{CONTOURS}, i AS (SELECT a.scene_id, a.face_id, b.contour_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) AS v, (a.x1 - a.x0) * (a.z1 - a.z0) + (b.x1 - b.x0) * (b.z1 - b.z0) AS s FROM faces a JOIN o b ON a.scene_id = b.scene_id),
  best AS (SELECT scene_id, face_id, contour_id, v / (s - v) AS iou FROM i WHERE v / (s - v) > 0.15 QUALIFY row_number() OVER (PARTITION BY scene_id, face_id ORDER BY v / (s - v) DESC, contour_id) = 1)"""


def _contours(spark, sf_dir):
    i = F.col("face_id")
    return bridge(spark, sf_dir, "faces").select("scene_id", (i + 1000000).alias("contour_id"), (F.col("x0") + i % 7 * 0.4).alias("x0"), (F.col("x1") + i % 5 * 0.3).alias("x1"), (F.col("z0") - i % 3 * 0.5).alias("z0"), (F.col("z1") - i % 4 * 0.9).alias("z1"), "confidence")


@query("fusion_union", f"""WITH {FUSED} SELECT scene_id, face_id, contour_id, 'fused' AS source, round(least(1, confidence + 0.2 * iou), 5) + 0.0 AS confidence, false AS review FROM faces JOIN best USING (scene_id, face_id)
  UNION ALL SELECT scene_id, face_id, NULL, 'lidar', round(confidence * 0.8, 5) + 0.0, true FROM faces WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.scene_id = faces.scene_id AND b.face_id = faces.face_id)
  UNION ALL SELECT scene_id, NULL, contour_id, 'image', round(confidence * 0.6, 5) + 0.0, true FROM o WHERE (x1 - x0) * (z1 - z0) >= 3 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.scene_id = o.scene_id AND b.contour_id = o.contour_id)""", "faces")
def fusion_union(spark, sf_dir):
    df = op.fuse(bridge(spark, sf_dir, "faces"), _contours(spark, sf_dir))
    return df.select("scene_id", "face_id", "contour_id", "source", fixed("confidence", 5).alias("confidence"), "review")


@query("fusion_iou_match", f"WITH {FUSED} SELECT scene_id, face_id, contour_id, round(iou, 6) + 0.0 AS iou FROM best", "faces")
def fusion_iou_match(spark, sf_dir):
    return op.iou_match(bridge(spark, sf_dir, "faces"), _contours(spark, sf_dir)).select("scene_id", "face_id", "contour_id", fixed("iou", 6).alias("iou"))


@query("edge_snap", f"""WITH v AS (SELECT scene_id, face_id * 4 + s.i AS pid, CASE WHEN s.i IN (0, 3) THEN x0 ELSE x1 END + 0.11 AS x, CASE WHEN s.i < 2 THEN z0 ELSE z1 END - 0.07 AS z FROM faces, (SELECT unnest([0, 1, 2, 3]) AS i) s), {CONTOURS},
  g AS (SELECT scene_id, contour_id AS id, x0, z0, x1, z1 FROM o), w AS (SELECT v.*, g.*, (g.x1 - g.x0) ** 2 + (g.z1 - g.z0) ** 2 AS l FROM v JOIN g ON v.scene_id = g.scene_id), t AS (SELECT *, least(1, greatest(0, ((x - x0) * (x1 - x0) + (z - z0) * (z1 - z0)) / l)) AS t FROM w),
  n AS (SELECT scene_id, pid, id, x0 + t * (x1 - x0) AS nx, z0 + t * (z1 - z0) AS nz, sqrt((x - (x0 + t * (x1 - x0))) ** 2 + (z - (z0 + t * (z1 - z0))) ** 2) AS gap FROM t)
  SELECT scene_id, pid, id AS segment_id, round(nx, 5) + 0.0 AS nx, round(nz, 5) + 0.0 AS nz FROM n WHERE gap < 0.5 QUALIFY row_number() OVER (PARTITION BY scene_id, pid ORDER BY round(gap, 9), id) = 1""", "faces")
def edge_snap(spark, sf_dir):
    v = op.vertices(_faces(spark, sf_dir)).select("scene_id", (F.col("face_id") * 4 + F.col("i")).alias("pid"), (F.col("x") + 0.11).alias("x"), (F.col("z") - 0.07).alias("z"))
    segments = _contours(spark, sf_dir).withColumnRenamed("contour_id", "segment_id")
    return op.nearest_on_segments(v, segments).select("scene_id", "pid", "segment_id", fixed("nx", 5).alias("nx"), fixed("nz", 5).alias("nz"))


FACING = "fc AS (SELECT scene_id, face_id, CAST((face_id % 4) * 90 + (face_id % 7) * 5 - 15 AS DOUBLE) AS azimuth, 20 + (face_id % 5) * 3.0 AS pitch, 5 + (face_id % 6) * 0.4 AS height FROM faces)"
SISTERS = f"{FACING}, sis AS (SELECT a.scene_id, a.face_id AS p, b.face_id AS q FROM fc a JOIN fc b ON a.scene_id = b.scene_id AND a.face_id < b.face_id WHERE abs((a.azimuth - b.azimuth + 720) % 360 - 180) <= 20 AND abs(a.pitch - b.pitch) <= 10 AND abs(a.height - b.height) <= 1.5)"


def _facing(spark, sf_dir):
    i = F.col("face_id")
    return bridge(spark, sf_dir, "faces").select("scene_id", "face_id", (i % 4 * 90 + i % 7 * 5 - 15).cast("double").alias("azimuth"), (20 + i % 5 * 3).cast("double").alias("pitch"), (5 + i % 6 * num(0.4)).alias("height"))


@query("sister_faces", f"WITH {SISTERS} SELECT * FROM sis", "faces")
def sister_faces(spark, sf_dir):
    return op.sisters(_facing(spark, sf_dir))


@query("sister_structures", f"""WITH RECURSIVE {SISTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY p, q) AS k FROM sis),
  st AS (SELECT scene_id, 0::BIGINT AS k, MAP([]::BIGINT[], []::BIGINT[]) AS m FROM (SELECT DISTINCT scene_id FROM sis)
    UNION ALL SELECT st.scene_id, o.k, map_concat(m, MAP([p, q], [coalesce(m[p], m[q], p), coalesce(m[p], m[q], p)])) FROM st JOIN o ON o.scene_id = st.scene_id AND o.k = st.k + 1),
  last AS (SELECT scene_id, unnest(map_entries(m)) AS e FROM st QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY k DESC) = 1)
  SELECT scene_id, e.key AS face_id, e.value AS structure FROM last""", "faces")
def sister_structures(spark, sf_dir):
    return op.structures(op.sisters(_facing(spark, sf_dir)))


@query("oriented_rect", """WITH s AS (SELECT scene_id, face_id, x0, x1, z0, z1, face_id % 5 / 10.0 AS t FROM faces), v AS (SELECT scene_id, face_id, i, x * cos(t) - z * sin(t) AS x, x * sin(t) + z * cos(t) AS z FROM (SELECT scene_id, face_id, t, i, CASE WHEN i IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN i < 2 THEN z0 ELSE z1 END AS z FROM s, (SELECT unnest([0, 1, 2, 3]) AS i) k)),
  w AS (SELECT a.scene_id, a.face_id, a.i, atan2(b.z - a.z, b.x - a.x) AS angle FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.face_id = b.face_id AND b.i = (a.i + 1) % 4), r AS (SELECT w.scene_id, w.face_id, w.i, max(x * cos(angle) + z * sin(angle)) - min(x * cos(angle) + z * sin(angle)) AS du, max(z * cos(angle) - x * sin(angle)) - min(z * cos(angle) - x * sin(angle)) AS dw FROM w JOIN v USING (scene_id, face_id) GROUP BY 1, 2, 3)
  SELECT scene_id, face_id, round(greatest(du, dw), 4) + 0.0 AS length, round(least(du, dw), 4) + 0.0 AS breadth, round(du * dw, 4) + 0.0 AS area FROM r QUALIFY row_number() OVER (PARTITION BY scene_id, face_id ORDER BY round(du * dw, 6), i) = 1""", "faces")
def oriented_rect(spark, sf_dir):
    t = F.col("face_id") % 5 / 10
    turn = lambda f: F.transform(F.arrays_zip("xs", "zs"), f)
    df = _faces(spark, sf_dir).select("scene_id", "face_id", turn(lambda v: v["xs"] * F.cos(t) - v["zs"] * F.sin(t)).alias("a"), turn(lambda v: v["xs"] * F.sin(t) + v["zs"] * F.cos(t)).alias("b"))
    df = op.smallest_rectangle(df.select("scene_id", "face_id", F.col("a").alias("xs"), F.col("b").alias("zs")))
    return df.select("scene_id", "face_id", fixed("length", 4).alias("length"), fixed("breadth", 4).alias("breadth"), fixed("area", 4).alias("area"))


@query("point_in_polygon", "SELECT p.scene_id, pid, face_id FROM points p JOIN (SELECT scene_id, face_id, x0 - 12 AS x0, x1 - 12 AS x1, z0 - 8 AS z0, z1 - 8 AS z1 FROM faces) f ON p.scene_id = f.scene_id WHERE x >= x0 AND x < x1 AND z >= z0 AND z < z1", "points", "faces")
def point_in_polygon(spark, sf_dir):
    faces = _faces(spark, sf_dir).select("scene_id", "face_id", F.transform("xs", lambda x: x - 12).alias("xs"), F.transform("zs", lambda z: z - 8).alias("zs"))
    return op.points_in(bridge(spark, sf_dir, "points"), faces)


@query("crm_faces", f"""WITH {FULL}, {ADJACENT}, n AS (SELECT scene_id, p AS face_id, q AS other FROM adj UNION ALL SELECT scene_id, q, p FROM adj), s AS (SELECT *, CASE WHEN face_id % 3 = 0 THEN area / 4 ELSE area END AS lot FROM g),
  d AS (SELECT s.scene_id, s.face_id AS id, n.other AS face_id FROM s JOIN n USING (scene_id, face_id) JOIN s o ON o.scene_id = s.scene_id AND o.face_id = n.other WHERE s.lot <= 10 AND s.elevation >= 1 AND s.width >= 0.3 AND s.depth >= 0.3 AND o.lot > 2 * s.lot QUALIFY row_number() OVER (PARTITION BY s.scene_id, s.face_id ORDER BY n.other) = 1),
  l AS (SELECT scene_id, face_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS dormers FROM d GROUP BY 1, 2)
  SELECT scene_id, face_id, round(x0, 3) + 0.0 AS x0, round(z0, 3) + 0.0 AS z0, round(x1, 3) + 0.0 AS x1, round(z1, 3) + 0.0 AS z1, 4 * pitch AS pitches, elevation AS height, CASE WHEN area < 5 AND elevation > 2 THEN '#c46b6b' WHEN area < 15 AND height < 3 THEN '#d4a843' WHEN area < 30 AND elevation < 1.5 THEN '#7bc47f' ELSE '#4a90d9' END AS color, coalesce(dormers, '') AS dormers FROM g LEFT JOIN l USING (scene_id, face_id)""", "faces")
def crm_faces(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    small = F.when(F.col("face_id") % 3 == 0, F.col("area") / 4).otherwise(F.col("area"))
    df = op.crm_faces(faces, op.dormers(faces.withColumn("area", small), op.adjacency(faces)))
    corner = lambda i, k: fixed(F.get("corners", F.lit(i))[k], 3)
    sections = F.aggregate("section_pitches", num(0), lambda a, p: a + p)
    return df.select("scene_id", "face_id", corner(0, "x").alias("x0"), corner(0, "z").alias("z0"), corner(2, "x").alias("x1"), corner(2, "z").alias("z1"), sections.alias("pitches"), "height", "color", F.concat_ws(",", F.transform("dormers", lambda d: d["id"].cast("string"))).alias("dormers"))


@query("plane_cap", f"WITH {FULL} SELECT scene_id, face_id, row_number() OVER (PARTITION BY scene_id ORDER BY area DESC, face_id) AS rank FROM g QUALIFY rank <= 3", "faces")
def plane_cap(spark, sf_dir):
    return op.largest_planes(_faces(spark, sf_dir), 3).select("scene_id", "face_id", "rank")
