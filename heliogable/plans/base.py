"""How queries are registered, and the relations that they derive from the driver's tables.

A bridge relation is one text of integer arithmetic that both engines evaluate
alike; it is the only thing that a query and its oracle share.  The oracles
themselves are written out in SQL on their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: Centimetres as metres, in doubles on both sides.
M = "CAST({0} AS DOUBLE) / CAST(100 AS DOUBLE)"

BRIDGE = {
    # A building's cloud: a point for each line, about 4000 on 28 x 28 m, an E-W gable of 12 x 10 m with a ring of ground, noise in centimetres.
    # Points are numbered within their order, so no task sees more than one order; lines equal in the three columns give equal points.
    "points": f"""
        SELECT scene_id, pid, xi, zi, {M.format("(xi - 1400)")} AS x, {M.format("(zi - 1400)")} AS z,
               CASE WHEN ABS(xi - 1400) <= 600 AND ABS(zi - 1400) <= 500
                    THEN CAST(6 AS DOUBLE) - {M.format("ABS(zi - 1400)")} / CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / CAST(10 AS DOUBLE) END
               + CAST((orderkey * 13 + linenumber) % 7 - 3 AS DOUBLE) / CAST(100 AS DOUBLE) AS y
        FROM (SELECT CAST(FLOOR(l_orderkey / 1000) AS BIGINT) AS scene_id, l_orderkey * 1024 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pid,
                     l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, (l_partkey * 7919 + l_linenumber * 31) % 2800 AS xi, (l_suppkey * 104729 + l_orderkey * 17) % 2800 AS zi
              FROM lineitem) AS p""",
    "sections": """
        SELECT p_partkey AS section_id, CAST((p_size * 37) % 360 AS DOUBLE) AS azimuth, CAST(p_partkey % 61 AS DOUBLE) AS pitch, CAST(1 + p_partkey % 50 AS DOUBLE) AS area FROM part""",
    # Rectangles on a grid of streets: neighbours touch or nearly so.
    "faces": f"""
        SELECT s_suppkey AS face_id, CAST(FLOOR(s_suppkey / 12) AS BIGINT) AS scene_id, k,
               {M.format("(k % 4) * 600 - (s_suppkey % 3) * 20")} AS x0, {M.format("(k % 4) * 600 + 500 - (s_suppkey % 5) * 30 + (s_suppkey % 2) * 130")} AS x1,
               {M.format("CAST(FLOOR(k / 4) AS BIGINT) * 500")} AS z0, {M.format("CAST(FLOOR(k / 4) AS BIGINT) * 500 + 460 + (s_suppkey % 4) * 20 - (s_suppkey % 6) * 70")} AS z1,
               CAST((s_suppkey * 7) % 64 AS DOUBLE) AS pitch, CAST((s_suppkey % 8) * 45 AS DOUBLE) AS azimuth,
               {M.format("300 + (s_suppkey * 31) % 400")} AS height, {M.format("(s_suppkey * 17) % 300")} AS elevation, {M.format("35 + (s_suppkey * 13) % 65")} AS confidence
        FROM (SELECT s_suppkey, s_suppkey % 12 AS k FROM supplier) AS s""",
    "audit": """
        SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 37 = 0 THEN 'error' ELSE 'ok' END AS replay,
               CASE o_orderstatus WHEN 'F' THEN 'auto_accept' WHEN 'O' THEN 'needs_review' ELSE 'reject' END AS status,
               CAST(FLOOR(o_totalprice / 20) AS BIGINT) AS runtime_ms, CAST(o_orderkey % 9 AS BIGINT) AS faces, CAST(o_custkey % 4 AS BIGINT) AS main_faces,
               CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS whole_story, CAST((o_orderkey * 3) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS uncertainty,
               CAST(o_custkey % 3 AS BIGINT) AS contradictions, CAST((o_orderkey * 7) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS pair_coverage,
               CAST((o_custkey * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS main_fraction, CAST(o_orderkey % 4 AS BIGINT) AS ground_suppressed,
               o_custkey % 13 = 0 AS likely_ground, o_custkey % 11 = 0 AS p8_corrected, CASE o_orderkey % 6 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'low_pitch' ELSE NULL END AS p9_reason,
               o_custkey % 17 = 0 AS rescued_5, o_custkey % 19 = 0 AS rescued_6, o_custkey % 7 = 0 AS escalated, CAST((o_custkey * 5) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
               CAST((o_orderkey * 13) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS structure
        FROM orders""",
    # Image regions and lines from events: one roof for each user.
    "regions": f"""
        SELECT event_id AS region_id, user_id AS roof_id, {M.format("50 + (event_id * 37) % 6000")} AS area, {M.format("(event_id * 53) % 100")} AS compactness,
               {M.format("100 + (event_id * 29) % 700")} AS aspect, {M.format("(event_id * 41) % 100")} AS green, {M.format("(event_id * 59) % 100")} AS veto, {M.format("(event_id * 61) % 101")} AS overlap,
               {M.format("(event_id * 67) % 100")} AS confidence, {M.format("(event_id * 71) % 100")} AS texture, CAST(3 + event_id % 12 AS BIGINT) AS vertices,
               {M.format("(event_id * 73) % 4000")} AS x0, {M.format("(event_id * 79) % 4000")} AS z0, {M.format("100 + (event_id * 83) % 900")} AS w, {M.format("100 + (event_id * 89) % 900")} AS h
        FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    text = BRIDGE[name]
    used = [t for t in TABLES if f"FROM {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def sql(text: str, *relations: str) -> str:
    """An oracle with the derived relations that it names in front."""
    lead = ", ".join(f"{r} AS ({BRIDGE[r]})" for r in relations)
    if not lead:
        return text
    body = text.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {lead}, {body[14:].strip()}"
    return f"WITH {lead}, {body[4:].strip()}" if body[:5].upper() == "WITH " else f"WITH {lead} {body}"


def query(name: str, oracle: str | None = None, *relations: str):
    """Register a query, and its oracle where SQL can say it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, *relations)
        return f

    return keep
