"""Whole-roof rules: cleanup, gates, cross-checks with solar segments, pairing, consistency, corrections, skeleton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import clip, first_true, flags, num

STEEPEST, NARROWEST, SMALLEST_SHARE, WORST_FIT = 60.0, 2.0, 0.10, 0.30


def turn_between(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, num(360)) - 180)


def clean(faces: DataFrame) -> DataFrame:
    """Faces with ``dropped_by``: steep, narrow, then small beside the largest left, then ill-fitting, steep and small; null for what stays.

    The later rules compare with the largest face that the earlier ones left.
    """
    c = F.col
    early = first_true((c("pitch") > STEEPEST, "steep"), (F.least("width", "depth") < NARROWEST, "narrow"))
    df = faces.withColumn("early", early)
    largest = F.max(F.when(c("early").isNull(), c("area"))).over(Window.partitionBy("scene_id"))
    df = df.withColumn("share", c("area") / largest)
    late = first_true((c("share") < SMALLEST_SHARE, "small"), ((c("misfit") > WORST_FIT) & (c("pitch") > 40) & (c("share") < 0.50), "bad_fit"))
    return df.withColumn("dropped_by", F.coalesce("early", late)).drop("early", "share")


def tilt_gate(faces: DataFrame) -> DataFrame:
    """scene_id, n, steep, downgrade: two faces or more of which 40 % lie over 40 degrees."""
    df = faces.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(F.col("pitch") > 40).alias("steep"))
    return df.withColumn("downgrade", (F.col("n") >= 2) & (F.col("steep") * 5 >= F.col("n") * 2))


def match_segments(faces: DataFrame, segments: DataFrame, within: float = 8.0) -> DataFrame:
    """Faces with their scene's nearest segment under 8 m (ties to a nanometre: smaller id): distance, confidence, corrected pitch."""
    c = F.col
    gap = F.sqrt((c("f.cx") - c("s.x")) ** 2 + (c("f.cz") - c("s.z")) ** 2)
    pairs = faces.alias("f").join(segments.alias("s"), c("f.scene_id") == c("s.scene_id")).select("f.scene_id", "f.face_id", F.struct(F.round(gap, 9).alias("gap"), c("s.segment_id").alias("segment_id"), c("s.pitch").alias("seg_pitch"), c("s.area").alias("seg_area")).alias("m"), gap.alias("exact"))
    best = pairs.filter(c("exact") < within).groupBy("scene_id", "face_id").agg(F.min("m").alias("m")).select("scene_id", "face_id", "m.*")
    df = faces.join(best, ["scene_id", "face_id"], "left").withColumn("match_confidence", F.when(c("gap").isNull(), num(0)).otherwise(F.greatest(num(0), 1 - c("gap") / within)))
    fix = c("gap").isNotNull() & (c("match_confidence") > 0.5) & (c("pitch") - c("seg_pitch") > 10) & (c("seg_pitch") < 45) & (c("seg_area") > 8)
    return df.withColumns({"corrected": F.coalesce(fix, F.lit(False)), "new_pitch": F.when(fix, c("seg_pitch") + 2).otherwise(c("pitch"))})


def cross_check(matched: DataFrame) -> DataFrame:
    """Of each scene with segments: mismatch of pitch, and the first of the ordered fallback reasons."""
    c = F.col
    hit = c("gap").isNotNull()
    off = hit & (F.abs(c("pitch") - c("seg_pitch")) > 15) & (c("match_confidence") > 0.3)
    df = matched.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("matched"), F.count_if(off).alias("off"), F.count_if(hit & (c("match_confidence") < 0.3)).alias("weak"), F.count_if("corrected").alias("corrected"))
    reason = first_true(((c("n") > 0) & (c("matched") == 0), "p9_build_unmatched"), ((c("n") >= 3) & (c("matched") * 2 < c("n")), "p9_low_match_fraction"), ((c("matched") >= 2) & (c("weak") * 2 >= c("matched")), "p9_low_match_confidence"))
    return df.withColumns({"pitch_mismatch": (c("matched") >= 2) & (c("off") * 2 >= c("matched")), "reason": reason})


def box_gap(p: str, q: str) -> Column:
    """Distance between boxes under two aliases."""
    dx = F.greatest(num(0), F.col(f"{p}.x0") - F.col(f"{q}.x1"), F.col(f"{q}.x0") - F.col(f"{p}.x1"))
    dz = F.greatest(num(0), F.col(f"{p}.z0") - F.col(f"{q}.z1"), F.col(f"{q}.z0") - F.col(f"{p}.z1"))
    return F.sqrt(dx * dx + dz * dz)


def mirrored_pairs(faces: DataFrame) -> DataFrame:
    """Pairs p < q that face away from each other (within 30 degrees) at like pitch (15) and under 25 m apart, with a score of 0.35 / 0.25 / 0.25 / 0.15."""
    c = F.col
    a, b = faces.alias("a"), faces.alias("b")
    df = a.join(b, (c("a.scene_id") == c("b.scene_id")) & (c("a.face_id") < c("b.face_id")))
    off = F.abs(turn_between(c("a.azimuth"), c("b.azimuth")) - 180)
    steps = F.abs(c("a.pitch") - c("b.pitch"))
    away = F.sqrt((c("a.cx") - c("b.cx")) ** 2 + (c("a.cz") - c("b.cz")) ** 2)
    df = df.select(c("a.scene_id").alias("scene_id"), c("a.face_id").alias("p"), c("b.face_id").alias("q"), off.alias("off"), steps.alias("steps"), away.alias("away"), box_gap("a", "b").alias("gap"), (F.least("a.area", "b.area") / F.greatest("a.area", "b.area")).alias("ratio"))
    df = df.filter("off <= 30 and steps <= 15 and away < 25")
    score = num(0.35) * (1 - c("off") / 30) + num(0.25) * (1 - c("steps") / 15) + num(0.25) * F.greatest(num(0), 1 - c("gap") / 10) + num(0.15) * c("ratio")
    return df.withColumn("score", score).withColumn("kind", first_true((F.round("score", 9) >= 0.75, "mirrored_gable_like"), (F.round("score", 9) >= 0.55, "mirrored_main_roof_like"), (F.round("score", 9) >= 0.35, "partial_mirror"), default="weak_candidate"))


def relationships(faces: DataFrame, reach: float = 4.0) -> DataFrame:
    """Pairs p < q under 4 m apart with what they are to each other, by azimuth, pitch, gap and whether both slope away from where they meet."""
    c = F.col
    a, b = faces.alias("a"), faces.alias("b")
    df = a.join(b, (c("a.scene_id") == c("b.scene_id")) & (c("a.face_id") < c("b.face_id"))).withColumn("gap", box_gap("a", "b")).filter(c("gap") < reach)
    mx = (F.greatest("a.x0", "b.x0") + F.least("a.x1", "b.x1")) / 2
    mz = (F.greatest("a.z0", "b.z0") + F.least("a.z1", "b.z1")) / 2
    # Azimuths are compass here: 0 slopes towards -z, 90 towards +x.
    down = lambda s: F.sin(F.radians(f"{s}.azimuth")) * (mx - c(f"{s}.cx")) - F.cos(F.radians(f"{s}.azimuth")) * (mz - c(f"{s}.cz"))
    df = df.select(c("a.scene_id").alias("scene_id"), c("a.face_id").alias("p"), c("b.face_id").alias("q"), "gap", turn_between(c("a.azimuth"), c("b.azimuth")).alias("turn"), F.abs(c("a.pitch") - c("b.pitch")).alias("steps"), F.round(down("a"), 9).alias("down_p"), F.round(down("b"), 9).alias("down_q"))
    shape = first_true(((c("down_p") < 0) & (c("down_q") < 0), "convex"), ((c("down_p") > 0) & (c("down_q") > 0), "concave"), default="mixed")
    df = df.withColumn("shape", shape)
    kind = first_true(
        ((c("turn") >= 140) & (c("steps") < 15) & (c("gap") < 3), "ridge_like"), ((c("turn") >= 30) & (c("turn") < 140) & (c("shape") == "convex") & (c("gap") < 3), "hip_like"),
        ((c("turn") >= 30) & (c("turn") < 140) & (c("shape") == "concave") & (c("gap") < 3), "valley_like"), ((c("turn") < 30) & (c("steps") < 8) & (c("gap") < 2), "seam_like"),
        ((c("turn") < 140) & (c("steps") >= 15) & (c("gap") < 3), "step_like"), default="uncertain",
    )
    return df.withColumn("kind", kind)


def consistency(df: DataFrame) -> DataFrame:
    """Rows with main, pairing, relations, realism (0 to 1), faces, main_faces, main_share, unsure, with contradictions, consistency and story."""
    c = F.col
    found = flags(
        ((c("main") >= 0.7) & (c("relations") < 0.4) & (c("faces") >= 3), "strong_main_body_but_weak_relationships"), ((c("relations") >= 0.6) & (c("main_faces") == 0) & (c("faces") >= 2), "strong_relationships_but_no_clear_main_body"),
        ((c("main_faces") >= 3) & (c("pairing") < 0.4), "many_main_faces_but_low_pair_coverage"), ((c("main_share") >= 0.7) & (c("unsure") > 0.6) & (c("main_faces") >= 2), "dominant_main_body_with_fragmented_relationships"),
        ((c("unsure") > 0.5) & (c("main_faces") >= 2), "high_uncertainty_on_main_faces"), ((c("unsure") > 0.7) & (c("main_faces") >= 3), "too_many_uncertain_main_relations"),
    )
    df = df.withColumn("contradictions", found)
    n = F.when(c("contradictions") == "", 0).otherwise(F.size(F.split("contradictions", r"\|")))
    calm = F.greatest(num(0), 1 - num(0.15) * n)
    many = num(0.30) * c("main") + num(0.25) * c("pairing") + num(0.25) * c("relations") + num(0.10) * c("realism") + num(0.10) * calm
    one = num(0.5) * c("main") + num(0.3) * c("realism") + num(0.2) * calm
    return df.withColumns({"consistency": F.when(c("faces") <= 1, one).otherwise(many), "story": F.greatest("main", "pairing", "relations")})


def edge_upgrade(edges: DataFrame) -> DataFrame:
    """Edges (turn, pitch_p, pitch_q, dot_p, dot_q, fused, rise) with their definite type; dots are downslope towards the edge."""
    c = F.col
    steps = F.abs(c("pitch_p") - c("pitch_q"))
    diverge, converge = (c("dot_p") < 0) & (c("dot_q") < 0), (c("dot_p") > 0) & (c("dot_q") > 0)
    strong = c("fused") >= 0.35
    kind = first_true(
        ((F.abs(c("turn") - 180) < 30) & (F.least("pitch_p", "pitch_q") > 8) & diverge & strong, "ridge"), (converge & (c("turn") > 90) & strong, "valley"), ((c("turn") >= 35) & (c("turn") <= 145) & diverge & strong, "hip"),
        ((F.least("pitch_p", "pitch_q") < 8) & (F.greatest("pitch_p", "pitch_q") > 15), "eave"), ((F.abs("rise") >= 0.3) & (steps < 10) & (c("turn") < 25), "step"), ((steps < 4) & (c("turn") < 12), "seam"), default="uncertain",
    )
    return edges.withColumn("edge_type", kind)


def flip_slopes(faces: DataFrame, ridges: DataFrame, least: float = 0.60, toward: float = 0.55) -> DataFrame:
    """Faces with azimuth turned by 180 where a ridge of fused score 0.6 or more lies down their slope; dominant faces stay."""
    c = F.col
    r = ridges.filter(c("fused") >= least).select("scene_id", F.explode(F.array("p", "q")).alias("face_id"), "mx", "mz")
    df = faces.join(r, ["scene_id", "face_id"])
    dx, dz = c("mx") - c("cx"), c("mz") - c("cz")
    size = F.sqrt(dx * dx + dz * dz)
    dot = F.when(size > 1e-9, (F.sin(F.radians("azimuth")) * dx - F.cos(F.radians("azimuth")) * dz) / F.when(size > 1e-9, size).otherwise(num(1))).otherwise(num(0))
    wrong = df.filter(~c("dominant") & (F.round(dot, 9) > toward)).select("scene_id", "face_id").distinct().withColumn("wrong", F.lit(True))
    df = faces.join(wrong, ["scene_id", "face_id"], "left").withColumn("flipped", F.coalesce("wrong", F.lit(False))).drop("wrong")
    return df.withColumn("new_azimuth", F.when(c("flipped"), F.pmod(c("azimuth") + 180, num(360))).otherwise(c("azimuth")))


def align_heights(ridges: DataFrame, faces: DataFrame, low: float = 0.5, high: float = 4.0) -> DataFrame:
    """Ridge pairs whose heights differ by 0.5 to 4 m, with the height both take: the dominant face's, if one is, else the mean."""
    c = F.col
    side = lambda k: faces.select("scene_id", c("face_id").alias(k), c("height").alias(f"h_{k}"), c("dominant").alias(f"d_{k}"))
    df = ridges.select("scene_id", "p", "q").join(side("p"), ["scene_id", "p"]).join(side("q"), ["scene_id", "q"]).withColumn("step", F.round(F.abs(c("h_p") - c("h_q")), 9)).filter((c("step") > low) & (c("step") < high))
    return df.withColumn("height", first_true((c("d_p") & ~c("d_q"), c("h_p")), (c("d_q") & ~c("d_p"), c("h_q")), default=(c("h_p") + c("h_q")) / 2))


def skeleton_levels(elements: DataFrame) -> DataFrame:
    """Elements (scene_id, length, connected_area) with weight and level: main from 0.65 of the scene's largest, secondary from 0.30; short ones are tertiary."""
    c = F.col
    df = elements.withColumn("weight", c("length") * c("connected_area"))
    df = df.withColumn("ratio", F.round(c("weight") / F.max("weight").over(Window.partitionBy("scene_id")), 9))
    return df.withColumn("level", first_true((c("length") < 1.5, "tertiary"), (c("ratio") >= 0.65, "main"), (c("ratio") >= 0.30, "secondary"), default="tertiary"))


def trust_gate(df: DataFrame) -> DataFrame:
    """Rows (ridges, main_ridges, covered, planes, conflicts, structural) with the first reason to skip corrections, and the trust score."""
    c = F.col
    share = c("covered") / F.greatest(c("planes"), F.lit(1))
    reason = first_true((c("ridges") < 1, "no_skeleton_elements"), (c("main_ridges") < 1, "no_main_ridge"), (F.round(share, 9) < 0.40, "coverage_too_low"), (c("conflicts") > 3, "too_many_conflicts"), (c("structural") < 1, "no_structural_edges"))
    score = (clip(c("ridges") / num(3), 0, 1) + (c("main_ridges") > 0).cast("double") + clip(share, 0, 1) + F.greatest(num(0), 1 - c("conflicts") / num(4)) + (c("structural") > 0).cast("double")) / 5
    return df.withColumns({"skipped": reason, "trust": score})
