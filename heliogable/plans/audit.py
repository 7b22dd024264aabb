"""Queries of the audit family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import audit as op
from heliogable.plans.base import bridge, query, table

BUCKETS = """b AS (SELECT *, CASE WHEN replay = 'error' THEN 'replay_failed' ELSE concat_ws('|',
  CASE status WHEN 'auto_accept' THEN 'clean_auto_accept' ELSE status END, CASE WHEN runtime_ms < 10000 THEN 'fast_under_10s' WHEN runtime_ms < 15000 THEN 'medium_10_to_15s' ELSE 'slow_over_15s' END,
  CASE WHEN whole_story < 0.5 THEN 'weak_whole_roof_story' END, CASE WHEN uncertainty > 0.6 THEN 'high_uncertainty' END, CASE WHEN contradictions > 0 THEN 'contradiction_present' END,
  CASE WHEN pair_coverage < 0.45 AND main_faces >= 2 THEN 'weak_pair_coverage' END, CASE WHEN main_fraction < 0.4 AND faces >= 2 THEN 'fragmented_main_body' END,
  CASE WHEN ground_suppressed > 0 THEN 'ground_suppression_triggered' END, CASE WHEN ground_suppressed >= 2 THEN 'heavy_suppression' END, CASE WHEN likely_ground THEN 'likely_ground_issue' END, CASE WHEN p8_corrected THEN 'p8_corrected' END,
  CASE p9_reason WHEN 'unmatched' THEN 'p9_unmatched' WHEN 'low_fraction' THEN 'p9_low_match_fraction' WHEN 'low_confidence' THEN 'p9_low_match_confidence' END,
  CASE WHEN rescued_5 THEN 'v3p5_rescued' END, CASE WHEN rescued_6 THEN 'v3p6_rescued' END, CASE WHEN escalated THEN 'v2p7_escalation_applied' END) END AS buckets FROM audit)"""
PRIORITY = f"""{BUCKETS}, w AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {w})" for b, w in op.PRIORITY.items())}) AS v(name, weight)),
  s AS (SELECT case_id, buckets, coalesce((SELECT sum(weight) FROM w WHERE list_contains(string_split(buckets, '|'), name)), 0) AS score FROM b),
  p AS (SELECT case_id, buckets, CAST(CASE WHEN buckets = 'replay_failed' THEN 99 WHEN score = 0 AND list_contains(string_split(buckets, '|'), 'needs_review') THEN 1 ELSE score END AS BIGINT) AS priority FROM s)"""


def _rows(spark, sf_dir):
    return op.buckets(bridge(spark, sf_dir, "audit"))


@query("audit_buckets", f"WITH {BUCKETS} SELECT case_id, buckets FROM b", "audit")
def audit_buckets(spark, sf_dir):
    return _rows(spark, sf_dir).select("case_id", "buckets")


@query("review_priority", f"WITH {PRIORITY} SELECT case_id, priority FROM p WHERE priority > 0", "audit")
def review_priority(spark, sf_dir):
    return op.priority(_rows(spark, sf_dir)).filter("priority > 0").select("case_id", "priority")


@query("bucket_counts", f"WITH {BUCKETS} SELECT bucket, count(*) AS n FROM (SELECT unnest(string_split(buckets, '|')) AS bucket FROM b) GROUP BY 1", "audit")
def bucket_counts(spark, sf_dir):
    return op.bucket_counts(_rows(spark, sf_dir))


RUN = "count(*) AS n, min(runtime_ms) AS min_ms, (list_sort(list(runtime_ms)))[(count(*) // 2 + 1)::INT] AS median_ms, CAST(floor(avg(runtime_ms) + 0.5) AS BIGINT) AS mean_ms, max(runtime_ms) AS max_ms"


@query("runtime_summary", f"SELECT {RUN} FROM audit WHERE replay <> 'error'", "audit")
def runtime_summary(spark, sf_dir):
    return op.runtimes(bridge(spark, sf_dir, "audit"))


@query("runtime_by_status", f"SELECT status, {RUN} FROM audit WHERE replay <> 'error' GROUP BY status", "audit")
def runtime_by_status(spark, sf_dir):
    return op.runtimes(bridge(spark, sf_dir, "audit"), ("status",))


@query("batch_summary", "SELECT count(*) AS total, count(*) FILTER (replay <> 'error') AS succeeded, count(*) FILTER (replay = 'error') AS failed, count(*) FILTER (replay <> 'error' AND status = 'auto_accept') AS auto_accept, count(*) FILTER (replay <> 'error' AND status = 'needs_review') AS needs_review, count(*) FILTER (replay <> 'error' AND status = 'reject') AS reject FROM audit", "audit")
def batch_summary(spark, sf_dir):
    good = F.col("replay") != "error"
    of = [F.count_if(good & (F.col("status") == s)).alias(s) for s in ("auto_accept", "needs_review", "reject")]
    return bridge(spark, sf_dir, "audit").agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), *of)


@query("csv_rows", f"""WITH {BUCKETS} SELECT case_id, concat_ws(',', case_id::VARCHAR, replay, CASE WHEN contains(p, '"') OR contains(p, ',') THEN '"' || replace(p, '"', '""') || '"' ELSE p END, runtime_ms::VARCHAR, buckets, coalesce(p9_reason, '')) AS line
  FROM (SELECT b.*, CASE WHEN case_id % 5 = 0 THEN 'say "' || status || '"' WHEN case_id % 5 = 1 THEN status || ', later' ELSE status END AS p FROM b)""", "audit")
def csv_rows(spark, sf_dir):
    note = F.when(F.col("case_id") % 5 == 0, F.concat(F.lit('say "'), "status", F.lit('"'))).when(F.col("case_id") % 5 == 1, F.concat("status", F.lit(", later"))).otherwise(F.col("status"))
    df = _rows(spark, sf_dir).withColumn("note", note)
    return df.select("case_id", op.csv_lines(df, ["case_id", "replay", "note", "runtime_ms", "buckets", "p9_reason"]).alias("line"))


REPORT = {
    "project_id": "'p' || case_id", "case_label": "CASE WHEN case_id % 5 = 0 THEN 'say \"' || status || '\"' WHEN case_id % 5 = 1 THEN status || ', later' ELSE status END", "replay_success": "CASE WHEN replay = 'error' THEN 'false' ELSE 'true' END",
    "replay_error": "CASE WHEN replay = 'error' THEN 'timeout' END", "final_status": "status", "face_count": "faces", "total_runtime_ms": "runtime_ms", "v2p0_hard_suppressed_count": "ground_suppressed", "v2p1_main_plane_count": "main_faces", "v2p4_uncertainty_ratio": "CAST(CAST(FLOOR(uncertainty * 100 + 0.5) AS INT) AS VARCHAR(9))",
    "p9_fallback_verdict": "p9_reason", "buckets": "buckets",
}


@query("report_lines", "WITH " + BUCKETS + " SELECT case_id, concat_ws(',', " + ", ".join(f"coalesce(CASE WHEN ({REPORT[c]})::VARCHAR SIMILAR TO '(?s).*[\",\n].*' THEN '\"' || replace(({REPORT[c]})::VARCHAR, '\"', '\"\"') || '\"' ELSE ({REPORT[c]})::VARCHAR END, '')" if c in REPORT else "''" for c in op.CSV_COLUMNS) + ") AS line FROM b", "audit")
def report_lines(spark, sf_dir):
    df = _rows(spark, sf_dir)
    df = df.select("case_id", *[(F.split("buckets", r"\|") if c == "buckets" else F.expr(e)).alias(c) for c, e in REPORT.items()])
    return df.select("case_id", op.report_lines(df).alias("line"))


@query("edge_score_stats", """WITH e AS (SELECT event_id, unnest(range(0, event_id % 5)) AS k FROM events), s AS (SELECT event_id, CASE WHEN (event_id + k) % 4 > 0 THEN ((event_id * 7 + k * 13) % 128) / 128.0::DOUBLE END AS score, ['high', 'medium', 'low'][((event_id + k * 2) % 3 + 1)::INT] AS confidence FROM e)
  SELECT v.event_id, count(score) AS n_scored, count(score) FILTER (confidence = 'high') AS n_high, count(score) FILTER (confidence = 'medium') AS n_medium, count(score) FILTER (confidence = 'low') AS n_low, round(avg(score), 2) AS mean_score FROM events v LEFT JOIN s USING (event_id) GROUP BY 1""")
def edge_score_stats(spark, sf_dir):
    i = F.col("event_id")
    names = F.array(*map(F.lit, ("high", "medium", "low")))
    edge = lambda k: F.struct(F.when((i + k) % 4 > 0, (i * 7 + k * 13) % 128 / 128).alias("score"), F.get(names, ((i + k * 2) % 3).cast("int")).alias("confidence"))
    edges = F.slice(F.transform(F.sequence(F.lit(0), F.lit(4)), edge), F.lit(1), (i % 5).cast("int"))
    df = op.edge_scores(table(spark, sf_dir, "events").select("event_id", edges.alias("edges")))
    return df.drop("edges")


DECIDE = """d AS (SELECT *, main_fraction < 0.4 AND faces >= 2 AS fragmented, 0.35 * whole_story + 0.25 * confidence + 0.20 * main_fraction + 0.10 * structure + 0.10 * pair_coverage AS support FROM audit),
  r AS (SELECT *, if(whole_story < 0.5, 0.30, 0) + if(fragmented, 0.20, 0) + if(pair_coverage < 0.4 AND main_faces >= 2, 0.15, 0) + if(structure < 0.4 AND main_faces >= 2, 0.10, 0) + if(uncertainty > 0.6, 0.10, 0)
        + if(contradictions >= 2, 0.15, 0) + if(ground_suppressed > 0, 0.10, 0) + if(likely_ground, 0.10, 0) + if(fragmented, 0.05, 0) AS risk FROM d),
  e AS (SELECT *, greatest(0, risk - CASE WHEN contradictions = 0 AND ground_suppressed = 0 AND NOT likely_ground AND NOT fragmented AND main_fraction >= 0.7 AND confidence >= 0.65 AND faces >= 3
        THEN 0.15 * greatest(0.5, least(1, greatest(0, ((main_fraction - 0.7) + (confidence - 0.65)) / 0.4))) ELSE 0 END) AS effective_risk FROM r),
  f AS (SELECT *, least(1, greatest(0, 0.5 + 0.5 * (support - effective_risk - least(0.24, 0.08 * least(contradictions, 3)) - 0.15 * least(1, greatest(0, (uncertainty - 0.5) / 0.5))))) AS final,
        concat_ws('|', CASE WHEN whole_story < 0.55 AND uncertainty > 0.55 THEN 'low_consistency_with_uncertainty' END, CASE WHEN contradictions >= 2 AND structure < 0.5 AND main_faces >= 2 THEN 'contradictions_with_weak_pairing' END,
        CASE WHEN fragmented AND pair_coverage < 0.5 AND main_faces >= 2 THEN 'fragmented_main_with_weak_relationships' END, CASE WHEN p8_corrected AND p9_reason IS NOT NULL AND whole_story < 0.45 THEN 'external_risk_with_weak_story' END,
        CASE WHEN fragmented THEN 'main_body_weak' END, CASE WHEN round(effective_risk, 9) >= 0.45 AND round(support - effective_risk, 9) < 0.25 THEN 'aggregate_risk_elevated' END) AS triggers FROM e)"""


@query("decision_layer", f"WITH {DECIDE} SELECT case_id, round(support, 6) + 0.0 AS support, round(effective_risk, 6) + 0.0 AS effective_risk, round(final, 6) + 0.0 AS final, triggers, CASE WHEN status = 'auto_accept' AND triggers <> '' THEN 'needs_review' ELSE status END AS decision FROM f", "audit")
def decision_layer(spark, sf_dir):
    df = op.decide(bridge(spark, sf_dir, "audit"))
    return df.select("case_id", fixed("support", 6).alias("support"), fixed("effective_risk", 6).alias("effective_risk"), fixed("final", 6).alias("final"), "triggers", "decision")


def _responses(spark, sf_dir):
    """Responses as JSON text; some leave things out, some are cut off."""
    return table(spark, sf_dir, "events").select("event_id", F.expr("""CASE WHEN event_id % 29 = 0 THEN '{"status": "auto' ELSE concat('{"project_id": "p', user_id, '"', if(event_id % 3 = 0, concat(', "label": "', event_type, '"'), ''), ', "status": "', if(event_id % 4 = 0, 'reject', 'auto_accept'), '"',
        if(event_id % 31 = 0, ', "error": "timeout"', ''), if(event_id % 2 = 0, concat(', "timings": {"total_ms": ', CAST(event_id % 20000 AS STRING), '}'), ''), ', "roof_faces": [', if(event_id % 5 = 0, '', '{"pitch": 20, "area": 3}'), if(event_id % 5 > 2, ', {"pitch": 2}', ''), ']',
        ', "reasons": ["a', CAST(event_id % 7 AS STRING), '", "b"], "whole": {"uncertainty": ', CAST(event_id % 10 AS STRING), '}, "edges": [{"score": ', CAST(event_id % 100 AS STRING), '}, {"score": ', CAST(event_id % 13 AS STRING), '}, {"confidence": "low"}]}') END""").alias("response"))


@query("audit_normalise", """WITH r AS (SELECT event_id, user_id, event_type, event_id % 29 = 0 AS bad FROM events)
  SELECT event_id, CASE WHEN NOT bad THEN 'p' || user_id END AS project_id, CASE WHEN NOT bad AND event_id % 3 = 0 THEN event_type ELSE 'unlabelled' END AS label, NOT bad AND event_id % 31 <> 0 AS replay_success,
    CASE WHEN bad THEN 'unknown' WHEN event_id % 4 = 0 THEN 'reject' ELSE 'auto_accept' END AS final_status, CAST(CASE WHEN bad OR event_id % 5 = 0 THEN 0 WHEN event_id % 5 > 2 THEN 2 ELSE 1 END AS BIGINT) AS face_count,
    CASE WHEN NOT bad AND event_id % 2 = 0 THEN CAST(event_id % 20000 AS DOUBLE) END AS total_runtime_ms, CASE WHEN NOT bad THEN CAST(event_id % 10 AS DOUBLE) END AS uncertainty,
    CASE WHEN bad THEN '' ELSE 'a' || (event_id % 7) || '|b' END AS review_reasons, CAST(CASE WHEN bad THEN 0 ELSE 2 END AS BIGINT) AS edge_scores, CASE WHEN NOT bad THEN round((event_id % 100 + event_id % 13) / 2, 2) END AS edge_score_mean FROM r""")
def audit_normalise(spark, sf_dir):
    df = op.normalise(_responses(spark, sf_dir))
    return df.select("event_id", "project_id", "label", "replay_success", "final_status", "face_count", "total_runtime_ms", "uncertainty", "review_reasons", "edge_scores", "edge_score_mean")


LINE_TYPES = "'eave', 'rake', 'ridge', 'hip', 'valley', 'uncertain'"


@query("line_audit_summary", f"WITH k AS (SELECT unnest([{LINE_TYPES}]) AS type), l AS (SELECT ([{LINE_TYPES}])[(event_id % 7 + 1)::INT] AS type, (event_id * 37 % 100) / 100.0 AS confidence, event_id % 3 > 0 AS supported FROM events) SELECT k.type, count(l.type) AS n, round(coalesce(avg(confidence), 0), 3) + 0.0 AS mean_confidence, count(*) FILTER (supported) AS supported FROM k LEFT JOIN l USING (type) GROUP BY 1")
def line_audit_summary(spark, sf_dir):
    types = ["eave", "rake", "ridge", "hip", "valley", "uncertain"]
    kinds = spark.createDataFrame([(t,) for t in types], "type string")
    lines = table(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, types)), (F.col("event_id") % 7).cast("int")).alias("type"), (F.col("event_id") * 37 % 100 / 100).alias("confidence"), (F.col("event_id") % 3 > 0).alias("supported"))
    own = lines.groupBy("type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.count_if("supported").alias("s"))
    return kinds.join(own, "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), fixed(F.coalesce("mean", F.lit(0.0)), 3).alias("mean_confidence"), F.coalesce("s", F.lit(0)).cast("long").alias("supported"))


@query("metric_diff", "WITH a AS (SELECT event_type || '_mean' AS metric, round(avg(value), 4) AS v FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' GROUP BY 1), b AS (SELECT event_type || '_mean' AS metric, round(avg(value), 4) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT metric, a.v AS a, b.v AS b, round(b.v - a.v, 3) + 0.0 AS delta FROM a FULL JOIN b USING (metric)")
def metric_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda k, out: e.filter((F.col("event_id") % 2 == k) & (F.col("event_type") != out)).groupBy(F.concat("event_type", F.lit("_mean")).alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    df = op.metric_diff(side(0, "error"), side(1, "view"))
    return df.select("metric", "a", "b", fixed("delta", 3).alias("delta"))
