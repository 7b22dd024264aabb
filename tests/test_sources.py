from __future__ import annotations

import base64
import json

import numpy as np
import pytest

from heliogable.sources import files


def test_requests(spark):
    good = {"project_id": "a", "lidar": {"points": [[-71.0, 42.0, 3.5, 2], [1.0, 2.0], [-71.1, 42.1, 4.5]]}}
    rows = [(1, json.dumps(good)), (2, json.dumps({"project_id": "b", "options": {"pipeline_mode": "image_engine"}})), (3, "{}"), (4, "not json"), (5, None)]
    df = files.parse_requests(spark.createDataFrame(rows, "id long, request string"))
    assert {r.id: r.errors for r in df.collect()} == {1: "", 2: "no_image", 3: "no_project|no_points", 4: "no_project|no_points", 5: "no_project|no_points"}
    assert [(r.pid, r.elev) for r in files.inline_points(df).collect()] == [(0, 3.5), (2, 4.5)]


def test_cases_and_catalogs(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"projectId": "p", "lat": 1.5}, {"label": "x"}]}, indent=1))
    assert [(r.place, r.projectId, r.label) for r in files.read_cases(spark, str(tmp_path / "cases.json")).collect()] == [(0, "p", None), (1, None, "x")]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no cases"):
        files.read_cases(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "cat.json").write_text(json.dumps({"modules": [{"id": "m", "rate": 2}, {"id": "n", "rate": 2.5, "extra": 1}]}))
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "cat.json"), "id: STRING, rate: DOUBLE", "modules").collect()] == [("m", 2.0), ("n", 2.5)]


def test_reports(spark):
    df = spark.createDataFrame([(2, "a|b"), (1, None)], "n long, s string")
    made = json.loads(files.envelope(df, "now").first().text)
    assert made["batch_size"] == 2 and [r["n"] for r in made["rows"]] == [1, 2]
    assert [r.line for r in files.markdown_table(df, ["n"]).orderBy("place").collect()] == ["| n | s |", "|---|---|", "| 1 |  |", r"| 2 | a\|b |"]


def test_grids(spark):
    r = files.grids(spark.createDataFrame([(1, 0, 0, 1.5), (1, 1, 2, 2.5)], "section_id long, row int, col int, kwh_m2 double")).first()
    grid = np.frombuffer(base64.b64decode(r.data), "<f4").reshape(r.height, r.width)
    assert grid.shape == (2, 3) and grid[0, 0] == 1.5 and grid[1, 2] == 2.5 and np.isnan(grid[0, 1])
