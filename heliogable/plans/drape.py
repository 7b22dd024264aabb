"""Queries of places in images, draped planes and directional votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed, num
from heliogable.operators import drape as op
from heliogable.operators import votes
from heliogable.plans.base import bridge, query, table
from heliogable.plans.planes import FIT, PLANES, _points

DOTS = """dt AS (SELECT c_custkey AS dot_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 42 + (c_custkey % 1000)::DOUBLE / 1000 END AS lat, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE -71 - (c_custkey * 7 % 1000)::DOUBLE / 1000 END AS lng,
  (c_custkey % 50)::DOUBLE AS x, (c_custkey % 31)::DOUBLE AS z, -72::DOUBLE AS west, CASE WHEN c_custkey % 11 = 0 THEN -72 ELSE -71 END::DOUBLE AS east, -14::DOUBLE AS x0, 14::DOUBLE AS x1, -10::DOUBLE AS z0, 10::DOUBLE AS z1 FROM customer)"""


@query("dot_placement", f"""WITH {DOTS} SELECT dot_id, round(CASE WHEN lat IS NULL OR lng IS NULL THEN x WHEN east = west THEN 0 ELSE -14 + 28 * (lng + 72) END, 6) + 0.0 AS px, round(CASE WHEN lat IS NULL OR lng IS NULL THEN z ELSE -10 + 20 * (lat - 42) END, 6) + 0.0 AS pz FROM dt""")
def dot_placement(spark, sf_dir):
    k = F.col("c_custkey")
    lat = F.when(k % 7 != 0, 42 + (k % 1000) / 1000)
    lng = F.when(k % 13 != 0, -71 - (k * 7 % 1000) / 1000)
    df = table(spark, sf_dir, "customer").select(
        k.alias("dot_id"), lat.alias("lat"), lng.alias("lng"), (k % 50).cast("double").alias("x"), (k % 31).cast("double").alias("z"), num(42).alias("south"), num(43).alias("north"), num(-72).alias("west"),
        F.when(k % 11 == 0, num(-72)).otherwise(num(-71)).alias("east"), num(-14).alias("x0"), num(14).alias("x1"), num(-10).alias("z0"), num(10).alias("z1"),
    )
    return op.dots_to_local(df).select("dot_id", fixed("px", 6).alias("px"), fixed("pz", 6).alias("pz"))


@query("pixel_places", "SELECT region_id, round(x0 / s + 320, 6) + 0.0 AS px, round(z0 / s + 240, 6) + 0.0 AS py, round(x0, 6) + 0.0 AS x FROM (SELECT *, CASE WHEN region_id % 3 = 0 THEN 0.1 ELSE 0.1 * (region_id % 3) END AS s FROM regions) r", "regions")
def pixel_places(spark, sf_dir):
    scale = op.pixel_scale(F.col("region_id") % 3 * num(0.1), num(0.1))
    px, py = op.to_pixel(F.col("x0"), scale, F.lit(640)), op.to_pixel(F.col("z0"), scale, F.lit(480))
    df = bridge(spark, sf_dir, "regions").select("region_id", px.alias("px"), py.alias("py"), op.from_pixel(px, scale, F.lit(640)).alias("x"))
    return df.select("region_id", *[fixed(c, 6).alias(c) for c in ("px", "py", "x")])


@query("held_segments", """WITH b AS (SELECT scene_id, face_id, floor(x0 * 2)::BIGINT + 4 AS c0, floor(x1 * 2)::BIGINT + 4 AS c1, floor(z0 * 2)::BIGINT + 12 AS r0, floor(z1 * 2)::BIGINT + 12 AS r1 FROM faces),
  q AS (SELECT scene_id, round_even(x * 2 + 28, 0) AS col, round_even(z * 2 + 28, 0) AS row FROM points) SELECT b.scene_id, face_id AS segment, count(*) AS n FROM b JOIN q ON b.scene_id = q.scene_id AND col >= c0 AND col <= c1 AND row >= r0 AND row <= r1 WHERE col < 56 AND row < 56 AND col >= 0 AND row >= 0 GROUP BY 1, 2 HAVING count(*) >= 10""", "points", "faces")
def held_segments(spark, sf_dir):
    run = lambda low, high, move: F.explode(F.sequence(F.floor(F.col(low) * 2) + move, F.floor(F.col(high) * 2) + move))
    masks = bridge(spark, sf_dir, "faces").withColumn("row", run("z0", "z1", 12)).withColumn("col", run("x0", "x1", 4)).select("scene_id", F.col("face_id").alias("segment"), "row", "col")
    return op.held_segments(bridge(spark, sf_dir, "points"), masks, 0.5, 56, 56)


# Every third segment is whole, the others squares of 0.7 and 1.4 m.
SEGMENTS = """sg AS (SELECT scene_id, face_id, x0 - 12 AS sx, CASE face_id % 3 WHEN 0 THEN x1 - 12 ELSE x0 - 12 + 0.7 * (face_id % 3) END AS tx, z0 - 8 AS sz, CASE face_id % 3 WHEN 0 THEN z1 - 8 ELSE z0 - 8 + 0.7 * (face_id % 3) END AS tz, confidence FROM faces),
  pl AS (SELECT p.*, face_id AS plane FROM points p JOIN sg ON p.scene_id = sg.scene_id AND x >= sx AND x < tx AND z >= sz AND z < tz)"""


@query("drape_points", f"""WITH {SEGMENTS}, {FIT}, hh AS (SELECT scene_id, plane, min(y) AS low, max(y) AS high FROM pl GROUP BY 1, 2), ff AS (SELECT scene_id, min(plane) AS first FROM fit WHERE n >= 10 GROUP BY 1),
  j AS (SELECT sg.*, CASE WHEN fit.n >= 10 THEN 'points' WHEN fit.n >= 3 THEN 'sparse' ELSE 'neighbour' END AS source, fit.n, fit.nx, fit.ny, fit.nz, low, high, g.nx AS gx, g.ny AS gy, g.nz AS gz, g.mx, g.my, g.mz FROM sg LEFT JOIN fit ON fit.scene_id = sg.scene_id AND fit.plane = sg.face_id LEFT JOIN hh ON hh.scene_id = sg.scene_id AND hh.plane = sg.face_id
    LEFT JOIN ff ON ff.scene_id = sg.scene_id AND ff.first < sg.face_id LEFT JOIN fit g ON g.scene_id = sg.scene_id AND g.plane = ff.first),
  c AS (SELECT *, my - (gx * (sx - mx) + gz * (sz - mz)) / gy AS a0, my - (gx * (tx - mx) + gz * (sz - mz)) / gy AS a1, my - (gx * (tx - mx) + gz * (tz - mz)) / gy AS a2, my - (gx * (sx - mx) + gz * (tz - mz)) / gy AS a3 FROM j WHERE source <> 'neighbour' OR gy IS NOT NULL),
  h AS (SELECT scene_id, face_id, source, CASE WHEN source = 'neighbour' THEN gy ELSE ny END AS up, CASE WHEN source = 'neighbour' THEN least(a0, a1, a2, a3) ELSE low END AS low, CASE WHEN source = 'neighbour' THEN greatest(a0, a1, a2, a3) ELSE high END AS high, 0.6 * confidence + 0.4 * least(1, CASE WHEN source = 'neighbour' THEN 4 ELSE n END / 200) AS sure, abs((tx - sx) * (tz - sz)) AS flat FROM c),
  k AS (SELECT *, flat / up AS area FROM h) SELECT scene_id, face_id, source, round(degrees(acos(least(1, up))), 3) + 0.0 AS pitch, round(low, 3) + 0.0 AS low, round(high, 3) + 0.0 AS high, round(area, 3) + 0.0 AS area, CASE WHEN area < 5 AND low > 2 THEN 'dormer' WHEN area < 15 AND high < 3 THEN 'porch' WHEN area < 30 AND low < 1.5 THEN 'garage' ELSE 'main' END AS plane_type,
    round(sure * CASE source WHEN 'points' THEN 1 WHEN 'sparse' THEN 0.5 ELSE 0.3 END, 5) + 0.0 AS confidence, source <> 'points' OR sure < 0.5 AS needs_review FROM k""", "points", "faces")
def drape_points(spark, sf_dir):
    part = lambda a, b, m: F.when(F.col("face_id") % 3 == 0, F.col(b) - m).otherwise(F.col(a) - m + 0.7 * (F.col("face_id") % 3))
    s = bridge(spark, sf_dir, "faces").select("scene_id", "face_id", F.col("face_id").alias("place"), (F.col("x0") - 12).alias("sx"), part("x0", "x1", 12).alias("tx"), (F.col("z0") - 8).alias("sz"), part("z0", "z1", 8).alias("tz"), "confidence")
    s = s.select("scene_id", "face_id", "place", F.array("sx", "tx", "tx", "sx").alias("xs"), F.array("sz", "sz", "tz", "tz").alias("zs"), "confidence")
    # The SQL bounds no area; upright planes only mustn't divide by zero.
    df = op.drape(bridge(spark, sf_dir, "points"), s, least_up=1e-300)
    return df.select("scene_id", "face_id", "source", *[fixed(c, 3).alias(c) for c in ("pitch", "low", "high", "area")], "plane_type", fixed("confidence", 5).alias("confidence"), "needs_review")


@query("plane_mean_height", f"WITH {PLANES} SELECT scene_id, plane, round(sum(y) / count(*), 6) + 0.0 AS level FROM pl WHERE plane >= 0 GROUP BY 1, 2", "points")
def plane_mean_height(spark, sf_dir):
    return votes.plane_heights(_points(spark, sf_dir)).select("scene_id", "plane", fixed("level", 6).alias("level"))


MARKED = "mk AS (SELECT *, CASE WHEN pid % 11 = 0 OR (plane >= 0 AND pid % 13 = 0) THEN 'unsure' WHEN plane >= 0 AND abs(z) < 0.2 THEN 'ridge_dot' WHEN plane >= 0 THEN 'roof' WHEN abs(x) > 11 THEN 'tree' ELSE 'ground' END AS label FROM pl)"


@query("directional_vote", f"""WITH {PLANES}, {MARKED}, ph AS (SELECT scene_id, plane, avg(y) AS level FROM pl WHERE plane >= 0 GROUP BY 1, 2), un AS (SELECT * FROM mk WHERE label = 'unsure'),
  pr AS (SELECT scene_id, pid, t, s, x + 0.3 * s * cos(t * pi() / 4) AS x, z + 0.3 * s * sin(t * pi() / 4) AS z FROM un, (SELECT unnest(range(8)) AS t) a, (SELECT unnest([1, 2, 3, 4, 5]) AS s) b), p9 AS (SELECT *, floor(x * 2) + dx AS cx, floor(z * 2) + dz AS cz FROM pr, (SELECT unnest([-1, 0, 1]) AS dx) c, (SELECT unnest([-1, 0, 1]) AS dz) d),
  vt AS (SELECT p.scene_id, p.pid, t, k.label, k.y AS h, k.label IN ('roof', 'ridge_dot') AS rf FROM p9 p JOIN mk k ON k.scene_id = p.scene_id AND floor(k.x * 2) = cx AND floor(k.z * 2) = cz WHERE k.label <> 'unsure' AND round(sqrt((p.x - k.x) ** 2 + (p.z - k.z) ** 2), 9) <= 0.18
    QUALIFY row_number() OVER (PARTITION BY p.scene_id, p.pid, t ORDER BY s, round(sqrt((p.x - k.x) ** 2 + (p.z - k.z) ** 2), 9), k.pid) = 1),
  tl AS (SELECT scene_id, pid, label AS top, count(*) AS tn FROM vt GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY scene_id, pid ORDER BY count(*) DESC, min(t)) = 1),
  ag AS (SELECT scene_id, pid, count(*) AS n, avg(h) AS m, count(*) FILTER (rf) AS r, count(*) FILTER (label = 'ground') AS g, count(*) FILTER (label = 'tree') AS tr, avg(h) FILTER (rf) AS rh, avg(h) FILTER (label = 'ground') AS gh FROM vt GROUP BY 1, 2 HAVING count(*) >= 3),
  al AS (SELECT ag.*, top, tn, y, round(abs(y - level), 9) AS pd, round(abs(y - rh), 9) AS rd, round(abs(y - gh), 9) AS gd, round(abs(y - m), 9) AS md FROM ag JOIN tl USING (scene_id, pid) JOIN un USING (scene_id, pid) LEFT JOIN ph USING (scene_id, plane)),
  rs AS (SELECT scene_id, pid, CASE WHEN tn >= greatest(6, floor(n * 0.75)) AND CASE WHEN top IN ('roof', 'ridge_dot') THEN CASE WHEN pd IS NOT NULL THEN pd < 2 ELSE md < 1.5 END WHEN top = 'ground' THEN y < 2 ELSE true END THEN top
    WHEN r >= 0.6 * n AND (coalesce(pd < 1.5, false) OR coalesce(rd < 1, false)) THEN 'roof' WHEN r >= 2 AND g >= 2 AND rd < gd AND y > gh + 0.5 THEN 'eave_dot' WHEN tr > 0.5 * n THEN CASE WHEN pd < 1 THEN NULL ELSE 'tree' END
    WHEN g > 0.5 * n AND y < 2 THEN 'ground' WHEN r >= 0.5 * n AND rd < 0.8 THEN 'roof' END AS label FROM al) SELECT * FROM rs WHERE label IS NOT NULL""", "points")
def directional_vote(spark, sf_dir):
    roof = F.col("plane") >= 0
    label = F.when((F.col("pid") % 11 == 0) | (roof & (F.col("pid") % 13 == 0)), "unsure").when(roof & (F.abs("z") < 0.2), "ridge_dot").when(roof, "roof").when(F.abs("x") > 11, "tree").otherwise("ground")
    return votes.directional_votes(_points(spark, sf_dir).withColumn("label", label))
