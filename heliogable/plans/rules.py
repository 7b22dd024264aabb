"""Queries of the whole-roof rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import rules as op
from heliogable.plans.base import bridge, query

BASE = "f AS (SELECT *, x1 - x0 AS width, z1 - z0 AS depth, (x1 - x0) * (z1 - z0) * CASE face_id % 9 WHEN 0 THEN 0.05 ELSE 1 END AS area, (x0 + x1) / 2 AS cx, (z0 + z1) / 2 AS cz, (face_id * 19 % 60) / 100.0 AS misfit, face_id % 5 = 0 AS dominant FROM faces)"


def _faces(spark, sf_dir):
    i = F.col("face_id")
    small = F.when(i % 9 == 0, F.lit(0.05)).otherwise(F.lit(1.0))
    return bridge(spark, sf_dir, "faces").select("*", (F.col("x1") - F.col("x0")).alias("width"), (F.col("z1") - F.col("z0")).alias("depth"), ((F.col("x1") - F.col("x0")) * (F.col("z1") - F.col("z0")) * small).alias("area"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("z0") + F.col("z1")) / 2).alias("cz"), (i * 19 % 60 / 100).alias("misfit"), (i % 5 == 0).alias("dominant"))


@query("cleanup_rules", f"WITH {BASE}, e AS (SELECT *, CASE WHEN pitch > 60 THEN 'steep' WHEN least(width, depth) < 2 THEN 'narrow' END AS early FROM f), m AS (SELECT scene_id, max(area) AS top FROM e WHERE early IS NULL GROUP BY 1) SELECT face_id, coalesce(early, CASE WHEN area < 0.1 * top THEN 'small' WHEN misfit > 0.3 AND pitch > 40 AND area < 0.5 * top THEN 'bad_fit' END) AS dropped_by FROM e LEFT JOIN m USING (scene_id)", "faces")
def cleanup_rules(spark, sf_dir):
    return op.clean(_faces(spark, sf_dir)).select("face_id", "dropped_by")


@query("tilt_gate", "SELECT scene_id, count(*) AS n, count(*) FILTER (pitch > 40) AS steep, count(*) >= 2 AND count(*) FILTER (pitch > 40) / count(*) >= 0.4 AS downgrade FROM faces GROUP BY 1", "faces")
def tilt_gate(spark, sf_dir):
    return op.tilt_gate(bridge(spark, sf_dir, "faces"))


MATCH = f"""{BASE}, s AS (SELECT scene_id, face_id AS segment_id, cx + (face_id % 11) AS x, cz - (face_id % 9) AS z, (face_id * 11 % 50)::DOUBLE AS seg_pitch, area AS seg_area FROM f WHERE face_id % 4 > 0),
  j AS (SELECT f.scene_id, f.face_id, segment_id, seg_pitch, seg_area, round(sqrt((cx - s.x) ** 2 + (cz - s.z) ** 2), 9) AS gap FROM f JOIN s ON f.scene_id = s.scene_id WHERE sqrt((cx - s.x) ** 2 + (cz - s.z) ** 2) < 8 QUALIFY row_number() OVER (PARTITION BY f.scene_id, f.face_id ORDER BY gap, segment_id) = 1),
  m AS (SELECT f.scene_id, f.face_id, f.pitch, j.gap, j.segment_id, j.seg_pitch, coalesce(greatest(0, 1 - gap / 8), 0) AS mc, coalesce(1 - gap / 8 > 0.5 AND pitch - seg_pitch > 10 AND seg_pitch < 45 AND seg_area > 8, false) AS corrected FROM f LEFT JOIN j USING (scene_id, face_id))"""


def _matched(spark, sf_dir):
    f, i = _faces(spark, sf_dir), F.col("face_id")
    segments = f.filter(i % 4 > 0).select("scene_id", i.alias("segment_id"), (F.col("cx") + i % 11).alias("x"), (F.col("cz") - i % 9).alias("z"), (i * 11 % 50).cast("double").alias("pitch"), "area")
    return op.match_segments(f, segments)


@query("solar_match", f"WITH {MATCH} SELECT face_id, segment_id, round(mc, 6) + 0.0 AS match_confidence, corrected, CASE WHEN corrected THEN seg_pitch + 2 ELSE pitch END AS new_pitch FROM m", "faces")
def solar_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("face_id", "segment_id", fixed("match_confidence", 6).alias("match_confidence"), "corrected", "new_pitch")


@query("solar_crossval", f"""WITH {MATCH}, a AS (SELECT scene_id, count(*) AS n, count(gap) AS matched, count(*) FILTER (gap IS NOT NULL AND abs(pitch - seg_pitch) > 15 AND mc > 0.3) AS off, count(*) FILTER (gap IS NOT NULL AND mc < 0.3) AS weak, count(*) FILTER (corrected) AS corrected FROM m GROUP BY 1)
  SELECT scene_id, matched, corrected, matched >= 2 AND off / matched >= 0.5 AS pitch_mismatch, CASE WHEN matched = 0 THEN 'p9_build_unmatched' WHEN n >= 3 AND matched / n < 0.5 THEN 'p9_low_match_fraction' WHEN matched >= 2 AND weak / matched >= 0.5 THEN 'p9_low_match_confidence' END AS reason FROM a""", "faces")
def solar_crossval(spark, sf_dir):
    return op.cross_check(_matched(spark, sf_dir)).select("scene_id", "matched", "corrected", "pitch_mismatch", "reason")


GAP = "sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ** 2 + greatest(0, a.z0 - b.z1, b.z0 - a.z1) ** 2)"
TURN = "abs(((a.azimuth - b.azimuth + 540) % 360) - 180)"


@query("mirrored_pairs", f"""WITH {BASE.replace("f AS (SELECT *,", "f AS (SELECT * REPLACE (pitch % 16 AS pitch),")}, p AS (SELECT a.scene_id, a.face_id AS p, b.face_id AS q, abs({TURN} - 180) AS o, abs(a.pitch - b.pitch) AS s, sqrt((a.cx - b.cx) ** 2 + (a.cz - b.cz) ** 2) AS w, {GAP} AS gap, least(a.area, b.area) / greatest(a.area, b.area) AS r FROM f a JOIN f b ON a.scene_id = b.scene_id AND a.face_id < b.face_id),
  q AS (SELECT *, 0.35 * (1 - o / 30) + 0.25 * (1 - s / 15) + 0.25 * greatest(0, 1 - gap / 10) + 0.15 * r AS score FROM p WHERE o <= 30 AND s <= 15 AND w < 25)
  SELECT scene_id, p, q, round(score, 6) + 0.0 AS score, CASE WHEN round(score, 9) >= 0.75 THEN 'mirrored_gable_like' WHEN round(score, 9) >= 0.55 THEN 'mirrored_main_roof_like' WHEN round(score, 9) >= 0.35 THEN 'partial_mirror' ELSE 'weak_candidate' END AS kind FROM q""", "faces")
def mirrored_pairs(spark, sf_dir):
    return op.mirrored_pairs(_faces(spark, sf_dir).withColumn("pitch", F.col("pitch") % 16)).select("scene_id", "p", "q", fixed("score", 6).alias("score"), "kind")


@query("face_relationships", f"""WITH {BASE}, p AS (SELECT a.scene_id, a.face_id AS p, b.face_id AS q, {GAP} AS gap, {TURN} AS turn, abs(a.pitch - b.pitch) AS steps, (greatest(a.x0, b.x0) + least(a.x1, b.x1)) / 2 AS mx, (greatest(a.z0, b.z0) + least(a.z1, b.z1)) / 2 AS mz, a.azimuth AS az, b.azimuth AS bz, a.cx AS ax, a.cz AS aw, b.cx AS bx, b.cz AS bw FROM f a JOIN f b ON a.scene_id = b.scene_id AND a.face_id < b.face_id WHERE {GAP} < 4),
  d AS (SELECT *, round(sin(radians(az)) * (mx - ax) - cos(radians(az)) * (mz - aw), 9) AS dp, round(sin(radians(bz)) * (mx - bx) - cos(radians(bz)) * (mz - bw), 9) AS dq FROM p), s AS (SELECT *, CASE WHEN dp < 0 AND dq < 0 THEN 'convex' WHEN dp > 0 AND dq > 0 THEN 'concave' ELSE 'mixed' END AS shape FROM d)
  SELECT scene_id, p, q, shape, CASE WHEN turn >= 140 AND steps < 15 AND gap < 3 THEN 'ridge_like' WHEN turn BETWEEN 30 AND 139.999 AND shape = 'convex' AND gap < 3 THEN 'hip_like' WHEN turn BETWEEN 30 AND 139.999 AND shape = 'concave' AND gap < 3 THEN 'valley_like' WHEN turn < 30 AND steps < 8 AND gap < 2 THEN 'seam_like' WHEN turn < 140 AND steps >= 15 AND gap < 3 THEN 'step_like' ELSE 'uncertain' END AS kind FROM s""", "faces")
def face_relationships(spark, sf_dir):
    return op.relationships(_faces(spark, sf_dir)).select("scene_id", "p", "q", "shape", "kind")


@query("whole_roof_consistency", """WITH r AS (SELECT case_id, main_fraction AS main, pair_coverage AS pairing, structure AS relations, confidence AS realism, faces, main_faces, whole_story AS share, uncertainty AS unsure FROM audit),
  c AS (SELECT *, [CASE WHEN main >= 0.7 AND relations < 0.4 AND faces >= 3 THEN 'strong_main_body_but_weak_relationships' END, CASE WHEN relations >= 0.6 AND main_faces = 0 AND faces >= 2 THEN 'strong_relationships_but_no_clear_main_body' END, CASE WHEN main_faces >= 3 AND pairing < 0.4 THEN 'many_main_faces_but_low_pair_coverage' END,
        CASE WHEN share >= 0.7 AND unsure > 0.6 AND main_faces >= 2 THEN 'dominant_main_body_with_fragmented_relationships' END, CASE WHEN unsure > 0.5 AND main_faces >= 2 THEN 'high_uncertainty_on_main_faces' END, CASE WHEN unsure > 0.7 AND main_faces >= 3 THEN 'too_many_uncertain_main_relations' END] AS l FROM r),
  k AS (SELECT *, list_filter(l, lambda x: x IS NOT NULL) AS fl FROM c), z AS (SELECT *, greatest(0, 1 - 0.15 * len(fl)) AS calm FROM k)
  SELECT case_id, array_to_string(fl, '|') AS contradictions, round(CASE WHEN faces <= 1 THEN 0.5 * main + 0.3 * realism + 0.2 * calm ELSE 0.3 * main + 0.25 * pairing + 0.25 * relations + 0.1 * realism + 0.1 * calm END, 6) + 0.0 AS consistency, greatest(main, pairing, relations) AS story FROM z""", "audit")
def whole_roof_consistency(spark, sf_dir):
    a = bridge(spark, sf_dir, "audit").select("case_id", F.col("main_fraction").alias("main"), F.col("pair_coverage").alias("pairing"), F.col("structure").alias("relations"), F.col("confidence").alias("realism"), "faces", "main_faces", F.col("whole_story").alias("main_share"), F.col("uncertainty").alias("unsure"))
    return op.consistency(a).select("case_id", "contradictions", fixed("consistency", 6).alias("consistency"), "story")


@query("edge_upgrade", """WITH e AS (SELECT region_id, (region_id * 23 % 181)::DOUBLE AS turn, (region_id * 7 % 50)::DOUBLE AS pp, (region_id * 9 % 50)::DOUBLE AS pq, (region_id % 7 - 3)::DOUBLE AS dp, (region_id % 5 - 2)::DOUBLE AS dq, confidence AS fused, (region_id % 9) / 10.0 AS rise FROM regions)
  SELECT region_id, CASE WHEN abs(turn - 180) < 30 AND least(pp, pq) > 8 AND dp < 0 AND dq < 0 AND fused >= 0.35 THEN 'ridge' WHEN dp > 0 AND dq > 0 AND turn > 90 AND fused >= 0.35 THEN 'valley' WHEN turn BETWEEN 35 AND 145 AND dp < 0 AND dq < 0 AND fused >= 0.35 THEN 'hip'
    WHEN least(pp, pq) < 8 AND greatest(pp, pq) > 15 THEN 'eave' WHEN abs(rise) >= 0.3 AND abs(pp - pq) < 10 AND turn < 25 THEN 'step' WHEN abs(pp - pq) < 4 AND turn < 12 THEN 'seam' ELSE 'uncertain' END AS edge_type FROM e""", "regions")
def edge_upgrade(spark, sf_dir):
    i = F.col("region_id")
    d = lambda c: c.cast("double")
    e = bridge(spark, sf_dir, "regions").select("region_id", d(i * 23 % 181).alias("turn"), d(i * 7 % 50).alias("pitch_p"), d(i * 9 % 50).alias("pitch_q"), d(i % 7 - 3).alias("dot_p"), d(i % 5 - 2).alias("dot_q"), F.col("confidence").alias("fused"), (i % 9 / 10).alias("rise"))
    return op.edge_upgrade(e).select("region_id", "edge_type")


RIDGES = f"{BASE}, r AS (SELECT a.scene_id, a.face_id AS p, b.face_id AS q, ((a.face_id + b.face_id) * 13 % 100) / 100.0 AS fused, (greatest(a.x0, b.x0) + least(a.x1, b.x1)) / 2 AS mx, (greatest(a.z0, b.z0) + least(a.z1, b.z1)) / 2 AS mz FROM f a JOIN f b ON a.scene_id = b.scene_id AND a.face_id < b.face_id WHERE {GAP} < 1)"


def _ridges(faces):
    a, b = faces.alias("a"), faces.alias("b")
    near = a.join(b, (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.face_id") < F.col("b.face_id"))).filter(op.box_gap("a", "b") < 1)
    return near.select("a.scene_id", F.col("a.face_id").alias("p"), F.col("b.face_id").alias("q"), ((F.col("a.face_id") + F.col("b.face_id")) * 13 % 100 / 100).alias("fused"), ((F.greatest("a.x0", "b.x0") + F.least("a.x1", "b.x1")) / 2).alias("mx"), ((F.greatest("a.z0", "b.z0") + F.least("a.z1", "b.z1")) / 2).alias("mz"))


@query("slope_flip", f"""WITH {RIDGES}, w AS (SELECT DISTINCT f.face_id FROM f JOIN r ON f.scene_id = r.scene_id AND f.face_id IN (r.p, r.q) WHERE NOT dominant AND fused >= 0.6 AND sqrt((mx - cx) ** 2 + (mz - cz) ** 2) > 1e-9 AND round((sin(radians(azimuth)) * (mx - cx) - cos(radians(azimuth)) * (mz - cz)) / sqrt((mx - cx) ** 2 + (mz - cz) ** 2), 9) > 0.55)
  SELECT face_id, face_id IN (SELECT face_id FROM w) AS flipped, CASE WHEN face_id IN (SELECT face_id FROM w) THEN (azimuth + 180) % 360 ELSE azimuth END AS new_azimuth FROM f""", "faces")
def slope_flip(spark, sf_dir):
    f = _faces(spark, sf_dir)
    return op.flip_slopes(f, _ridges(f)).select("face_id", "flipped", "new_azimuth")


@query("height_align", f"WITH {RIDGES} SELECT r.scene_id, r.p, r.q, round(CASE WHEN a.dominant AND NOT b.dominant THEN a.height WHEN b.dominant AND NOT a.dominant THEN b.height ELSE (a.height + b.height) / 2 END, 6) + 0.0 AS height FROM r JOIN f a ON a.scene_id = r.scene_id AND a.face_id = r.p JOIN f b ON b.scene_id = r.scene_id AND b.face_id = r.q WHERE round(abs(a.height - b.height), 9) > 0.5 AND round(abs(a.height - b.height), 9) < 4", "faces")
def height_align(spark, sf_dir):
    f = _faces(spark, sf_dir)
    return op.align_heights(_ridges(f), f).select("scene_id", "p", "q", fixed("height", 6).alias("height"))


@query("skeleton_hierarchy", "WITH e AS (SELECT region_id, roof_id, w AS length, area, w * area AS weight FROM regions), m AS (SELECT *, round(weight / max(weight) OVER (PARTITION BY roof_id), 9) AS r FROM e) SELECT region_id, round(weight, 6) + 0.0 AS weight, CASE WHEN length < 1.5 THEN 'tertiary' WHEN r >= 0.65 THEN 'main' WHEN r >= 0.3 THEN 'secondary' ELSE 'tertiary' END AS level FROM m", "regions")
def skeleton_hierarchy(spark, sf_dir):
    e = bridge(spark, sf_dir, "regions").select("region_id", F.col("roof_id").alias("scene_id"), F.col("w").alias("length"), F.col("area").alias("connected_area"))
    return op.skeleton_levels(e).select("region_id", fixed("weight", 6).alias("weight"), "level")


@query("trust_gate", """WITH t AS (SELECT case_id, case_id % 4 AS ridges, CASE WHEN case_id % 4 > 0 THEN case_id % 2 ELSE 0 END AS mains, case_id % 6 AS covered, case_id % 9 + 1 AS planes, case_id % 5 AS conflicts, case_id % 7 AS structural FROM audit)
  SELECT case_id, CASE WHEN ridges < 1 THEN 'no_skeleton_elements' WHEN mains < 1 THEN 'no_main_ridge' WHEN round(covered / planes, 9) < 0.4 THEN 'coverage_too_low' WHEN conflicts > 3 THEN 'too_many_conflicts' WHEN structural < 1 THEN 'no_structural_edges' END AS skipped,
    round((least(1, ridges / 3) + (mains > 0)::INT + least(1, covered / planes) + greatest(0, 1 - conflicts / 4) + (structural > 0)::INT) / 5, 6) + 0.0 AS trust FROM t""", "audit")
def trust_gate(spark, sf_dir):
    i = F.col("case_id")
    t = bridge(spark, sf_dir, "audit").select("case_id", (i % 4).alias("ridges"), F.when(i % 4 > 0, i % 2).otherwise(0).alias("main_ridges"), (i % 6).alias("covered"), (i % 9 + 1).alias("planes"), (i % 5).alias("conflicts"), (i % 7).alias("structural"))
    return op.trust_gate(t).select("case_id", "skipped", fixed("trust", 6).alias("trust"))
