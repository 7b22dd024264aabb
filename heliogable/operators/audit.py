"""Replay audits: flat rows, buckets, review priority, decisions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import clip, first_true, flags, num, total

#: The part of a replay response that rows are made of; what a response leaves out is null.
RESPONSE = (
    "project_id STRING, label STRING, status STRING, error STRING, reasons ARRAY<STRING>, roof_faces ARRAY<STRUCT<pitch DOUBLE, area DOUBLE>>,"
    "timings STRUCT<total_ms DOUBLE, model_ms DOUBLE>, ground STRUCT<hard_suppressed BIGINT, ground_like BIGINT>,"
    "whole STRUCT<consistency DOUBLE, story DOUBLE, uncertainty DOUBLE, contradictions ARRAY<STRING>>, edges ARRAY<STRUCT<score DOUBLE, confidence STRING>>"
)
#: Bucket: what it adds to the priority.
PRIORITY = {"reject": 10, "contradiction_present": 5, "weak_whole_roof_story": 5, "fragmented_main_body": 4, "high_uncertainty": 3, "heavy_suppression": 4, "ground_suppression_triggered": 2, "likely_ground_issue": 2, "slow_over_15s": 2, "p9_unmatched": 3, "p9_low_match_fraction": 2, "p9_low_match_confidence": 2}


def normalise(responses: DataFrame, json_col: str = "response") -> DataFrame:
    """One flat row for each response, with defaults; a response that can't be read is a failed row, not an error."""
    r = F.from_json(F.col(json_col), RESPONSE)
    df = responses.withColumn("_r", r)
    get = lambda path: F.col(f"_r.{path}")
    scores = F.filter(F.transform(F.coalesce(get("edges"), F.array().cast("array<struct<score:double,confidence:string>>")), lambda e: e["score"]), lambda s: s.isNotNull())
    return df.select(
        *[c for c in responses.columns if c != json_col], get("project_id").alias("project_id"), F.coalesce(get("label"), F.lit("unlabelled")).alias("label"),
        (get("status").isNotNull() & get("error").isNull()).alias("replay_success"), F.coalesce(get("status"), F.lit("unknown")).alias("final_status"),
        F.coalesce(F.size(get("roof_faces")), F.lit(0)).cast("long").alias("face_count"), get("timings.total_ms").alias("total_runtime_ms"), F.coalesce(get("timings.model_ms"), num(0)).alias("model_ms"),
        F.coalesce(get("ground.hard_suppressed"), F.lit(0)).cast("long").alias("ground_suppressed"), get("whole.consistency").alias("whole_story"), get("whole.uncertainty").alias("uncertainty"),
        F.coalesce(F.size(get("whole.contradictions")), F.lit(0)).cast("long").alias("contradictions"), F.coalesce(F.array_join(get("reasons"), "|"), F.lit("")).alias("review_reasons"),
        F.size(scores).cast("long").alias("edge_scores"), F.when(F.size(scores) > 0, F.round(F.aggregate(scores, num(0), lambda a, s: a + s) / F.size(scores), 2)).alias("edge_score_mean"),
    )


def buckets(df: DataFrame) -> DataFrame:
    """With ``buckets``: the names that apply, in a fixed order, joined by |."""
    c = F.col
    t = c("runtime_ms")
    known = c("status").isin("auto_accept", "needs_review", "reject")
    names = F.concat_ws(
        "|",
        F.when(c("status") == "auto_accept", F.lit("clean_auto_accept")).when(known, c("status")).otherwise(F.concat(F.lit("status_"), F.coalesce(c("status"), F.lit("unknown")))),
        first_true((t.isNull(), None), (t < 10000, "fast_under_10s"), (t < 15000, "medium_10_to_15s"), default="slow_over_15s"),
        flags(
            (c("whole_story") < 0.50, "weak_whole_roof_story"), (c("uncertainty") > 0.60, "high_uncertainty"), (c("contradictions") > 0, "contradiction_present"), ((c("pair_coverage") < 0.45) & (c("main_faces") >= 2), "weak_pair_coverage"),
            ((c("main_fraction") < 0.40) & (c("faces") >= 2), "fragmented_main_body"), (c("ground_suppressed") > 0, "ground_suppression_triggered"), (c("ground_suppressed") >= 2, "heavy_suppression"), (c("likely_ground"), "likely_ground_issue"), (c("p8_corrected"), "p8_corrected"),
            (c("p9_reason") == "unmatched", "p9_unmatched"), (c("p9_reason") == "low_fraction", "p9_low_match_fraction"), (c("p9_reason") == "low_confidence", "p9_low_match_confidence"), (c("rescued_5"), "v3p5_rescued"), (c("rescued_6"), "v3p6_rescued"), (c("escalated"), "v2p7_escalation_applied"),
        ),
    )
    names = F.rtrim(names, F.lit("|"))
    return df.withColumn("buckets", F.when(c("replay") == "error", F.lit("replay_failed")).otherwise(names))


def priority(df: DataFrame) -> DataFrame:
    """With ``priority`` of rows with buckets: 99 for a failed replay, else the buckets' sum; a mere needs_review is 1."""
    own = F.split("buckets", r"\|")
    has = lambda b: F.array_contains(own, b)
    score = total([F.when(has(b), F.lit(w)).otherwise(0) for b, w in PRIORITY.items()])
    return df.withColumn("priority", F.when(has("replay_failed"), F.lit(99)).when((score == 0) & has("needs_review"), F.lit(1)).otherwise(score).cast("long"))


def bucket_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("buckets", r"\|")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def runtimes(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, smallest, upper median, rounded mean and largest runtime of successful replays."""
    good = df.filter("replay <> 'error'").select(*by, "runtime_ms")
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    # The upper median is the value of rank floor(n / 2) + 1: counts by distinct value keep the sort small.
    counts = good.groupBy(*by, "runtime_ms").agg(F.count("*").alias("c"))
    ranked = counts.select("*", F.sum("c").over(own).alias("n"), F.sum("c").over(own.orderBy("runtime_ms")).alias("upto"))
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("runtime_ms")))
    mean = F.floor(F.sum(F.col("runtime_ms") * F.col("c")) / F.sum("c") + 0.5)
    return ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.min("runtime_ms").alias("min_ms"), middle.alias("median_ms"), mean.cast("long").alias("mean_ms"), F.max("runtime_ms").alias("max_ms"))


def csv_field(value: Column) -> Column:
    """A CSV field: quoted only where it holds a quote, comma or line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])


# The columns of the replay report, in order.
CSV_COLUMNS = (
    "project_id case_label address_label bucket_expected replay_success replay_error final_status face_count total_runtime_ms ml_runtime_ms crm_post_ml_ms top_hotspot v2p0_ground_like_count v2p0_hard_suppressed_count "
    "v2p1_structural_coherence_score v2p1_main_plane_count v2p1_mirrored_pair_count v2p2_main_roof_coherence_score v2p2_fragmented_main_roof v2p3_roof_relationship_coherence_score v2p3_main_relationship_count v2p3_uncertain_count "
    "v2p4_whole_roof_consistency_score v2p4_dominant_story_strength v2p4_uncertainty_ratio v2p7_support_score v2p7_risk_score v2p7_effective_risk_score v2p7_complexity_dampener v2p7_final_decision_score v2p7_decision_change_applied "
    "v2p7_clean_structural_story p8_pitch_correction_count p9_fallback_verdict p9_matched_fraction review_reasons v2p4_contradiction_flags v2p7_explicit_escalation_triggers v2p7_decision_reasons buckets visual_review_priority"
).split()


def report_lines(df: DataFrame) -> Column:
    """A line of the report for each row: all its columns in order, empty where the row has none; arrays joined by |."""
    kinds = dict(df.dtypes)
    value = lambda c: F.lit(None).cast("string") if c not in kinds else F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c)
    return F.concat_ws(",", *[csv_field(value(c)) for c in CSV_COLUMNS])


def edge_scores(df: DataFrame, edges: str = "edges") -> DataFrame:
    """With n_scored, n_high, n_medium, n_low and mean_score (two digits, null without any) of edges array<struct<score, confidence>>; edges without a score don't count."""
    scored = F.filter(F.coalesce(F.col(edges), F.array().cast(df.schema[edges].dataType)), lambda e: e["score"].isNotNull())
    df = df.withColumn("_s", scored).withColumn("n_scored", F.size("_s").cast("long"))
    among = lambda k: F.size(F.filter("_s", lambda e: F.coalesce(e["confidence"] == k, F.lit(False)))).cast("long")
    df = df.withColumns({f"n_{k}": among(k) for k in ("high", "medium", "low")})
    total_score = F.aggregate("_s", num(0), lambda a, e: a + e["score"])
    return df.withColumn("mean_score", F.when(F.col("n_scored") > 0, F.round(total_score / F.col("n_scored"), 2))).drop("_s")


def metric_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) over the union of both sides' metrics."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return both.select("metric", "a", "b", F.round(F.col("b") - F.col("a"), 3).alias("delta"))


def decide(df: DataFrame) -> DataFrame:
    """With support, risk, dampener, penalties, final score, triggers and the decision of the polished layer."""
    c = F.col
    clean = (c("contradictions") == 0) & (c("ground_suppressed") == 0) & ~c("likely_ground") & ~c("fragmented")
    df = df.withColumn("fragmented", (c("main_fraction") < 0.40) & (c("faces") >= 2))
    df = df.withColumn("support", num(0.35) * c("whole_story") + num(0.25) * c("confidence") + num(0.20) * c("main_fraction") + num(0.10) * c("structure") + num(0.10) * c("pair_coverage"))
    risks = ((c("whole_story") < 0.50, 0.30), ((c("main_fraction") < 0.40) & (c("faces") >= 2), 0.20), ((c("pair_coverage") < 0.40) & (c("main_faces") >= 2), 0.15), ((c("structure") < 0.40) & (c("main_faces") >= 2), 0.10), (c("uncertainty") > 0.60, 0.10), (c("contradictions") >= 2, 0.15), (c("ground_suppressed") > 0, 0.10), (c("likely_ground"), 0.10), (c("fragmented"), 0.05))
    df = df.withColumn("risk", total([F.when(cond, num(w)).otherwise(num(0)) for cond, w in risks]))
    bonus = clip(((c("main_fraction") - num(0.70)) + (c("confidence") - num(0.65))) / num(0.40), 0, 1)
    fit = clean & (c("main_fraction") >= 0.70) & (c("confidence") >= 0.65) & (c("faces") >= 3)
    df = df.withColumn("dampener", F.when(fit, num(0.15) * F.greatest(num(0.5), bonus)).otherwise(num(0)))
    df = df.withColumn("effective_risk", F.greatest(num(0), c("risk") - c("dampener")))
    df = df.withColumn("penalty", F.least(num(0.24), num(0.08) * F.least(c("contradictions"), F.lit(3))) + clip((c("uncertainty") - num(0.5)) / num(0.5), 0, 1) * num(0.15))
    df = df.withColumn("final", clip(num(0.5) + num(0.5) * (c("support") - c("effective_risk") - c("penalty")), 0, 1))
    df = df.withColumn("triggers", flags(
        ((c("whole_story") < 0.55) & (c("uncertainty") > 0.55), "low_consistency_with_uncertainty"), ((c("contradictions") >= 2) & (c("structure") < 0.50) & (c("main_faces") >= 2), "contradictions_with_weak_pairing"),
        (c("fragmented") & (c("pair_coverage") < 0.50) & (c("main_faces") >= 2), "fragmented_main_with_weak_relationships"), (c("p8_corrected") & c("p9_reason").isNotNull() & (c("whole_story") < 0.45), "external_risk_with_weak_story"),
        ((c("main_fraction") < 0.40) & (c("faces") >= 2), "main_body_weak"), ((F.round(c("effective_risk"), 9) >= 0.45) & (F.round(c("support") - c("effective_risk"), 9) < 0.25), "aggregate_risk_elevated"),
    ))
    return df.withColumn("decision", F.when((c("status") == "auto_accept") & (c("triggers") != ""), F.lit("needs_review")).otherwise(c("status")))
