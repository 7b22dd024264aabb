"""Requests, replay cases and catalogs in; envelopes, reports and grids out."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A parse request; what a request leaves out is null.
REQUEST = (
    "project_id STRING, design_center STRUCT<lat: DOUBLE, lng: DOUBLE>, anchor_dots ARRAY<STRUCT<id: STRING, x: DOUBLE, z: DOUBLE, lat: DOUBLE, lng: DOUBLE, label: STRING>>,"
    "calibration_offset STRUCT<tx: DOUBLE, tz: DOUBLE>, lidar STRUCT<points: ARRAY<ARRAY<DOUBLE>>, file_path: STRING, bounds: ARRAY<DOUBLE>, resolution: DOUBLE, source: STRING>,"
    "image STRUCT<url: STRING, file_path: STRING, width_px: INT, height_px: INT, resolution_m_per_px: DOUBLE>, options STRUCT<confidence_threshold: DOUBLE, max_planes: INT, merge_coplanar: BOOLEAN, pipeline_mode: STRING>"
)
CASES = "cases ARRAY<STRUCT<projectId: STRING, label: STRING, address: STRING, lat: DOUBLE, lng: DOUBLE, bucket_expected: STRING>>"


def parse_requests(texts: DataFrame, json_col: str = "request") -> DataFrame:
    """Requests in JSON text as columns, with ``errors``: what keeps one from being worked on, joined by |."""
    df = texts.withColumn("_r", F.from_json(json_col, REQUEST))
    df = df.select(*[c for c in texts.columns if c != json_col], "_r.*")
    mode = F.coalesce("options.pipeline_mode", F.lit("auto"))
    no_points = (mode != "image_engine") & (F.coalesce(F.size("lidar.points"), F.lit(0)) <= 0) & F.col("lidar.file_path").isNull()
    no_image = mode.isin("image_engine", "image_primary") & F.col("image.url").isNull() & F.col("image.file_path").isNull()
    return df.withColumn("errors", F.concat_ws("|", F.when(F.col("project_id").isNull(), "no_project"), F.when(no_points, "no_points"), F.when(no_image, "no_image")))


def inline_points(requests: DataFrame) -> DataFrame:
    """(project_id, pid, lng, lat, elev) of requests' points; entries of under three numbers are dropped."""
    df = requests.select("project_id", F.posexplode("lidar.points").alias("pid", "p")).filter(F.size("p") >= 3)
    return df.select("project_id", F.col("pid").cast("long").alias("pid"), *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(("lng", "lat", "elev"))])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Replay cases of a JSON file, in order; a file without ``cases`` is an error."""
    df = spark.read.schema(CASES).json(path, multiLine=True)
    found = F.when(F.col("cases").isNull(), F.raise_error(F.lit("the file has no cases"))).otherwise(F.col("cases"))
    return df.select(F.posexplode(found).alias("place", "c")).select("place", "c.*")


def read_catalog(spark: SparkSession, path: str, schema: str, entry: str | None = None) -> DataFrame:
    """Rows of a ragged catalog under an explicit schema: missing keys are null; ``entry`` names the array in an object."""
    if entry is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.schema(f"`{entry}` ARRAY<STRUCT<{schema}>>").json(path, multiLine=True).select(F.inline(entry))


def envelope(rows: DataFrame, generated_at: str) -> DataFrame:
    """One JSON text with the rows of a report; for results of report size only."""
    listed = F.array_sort(F.collect_list(F.struct(*rows.columns)))
    return rows.agg(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.count("*").alias("batch_size"), listed.alias("rows"))).alias("text"))


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table, with their place."""
    head = rows.sparkSession.createDataFrame([(-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + "---|" * len(rows.columns))], "place long, line string")
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit(r"\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("place"), line.alias("line"))
    return head.unionByName(body)


def grids(pixels: DataFrame) -> DataFrame:
    """(section_id, width, height, data) with data the row-major little-endian float32 grid in base64, NaN where no pixel is.

    A grid has at most 256 x 256 pixels, so a section is a small group.
    """

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        width, height = int(g["col"].max()) + 1, int(g["row"].max()) + 1
        grid = np.full((height, width), np.nan, "<f4")
        grid[g["row"], g["col"]] = g["kwh_m2"]
        return pd.DataFrame({"section_id": [g["section_id"].iloc[0]], "width": [width], "height": [height], "data": [base64.b64encode(grid.tobytes()).decode()]})

    return pixels.select("section_id", "row", "col", "kwh_m2").groupBy("section_id").applyInPandas(pack, "section_id long, width int, height int, data string")
