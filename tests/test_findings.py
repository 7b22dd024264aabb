"""Cases of the second review: limits that a rounding crossed, and searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogable.operators import points, rules


def matched(spark):
    """A segment a fifth of a nanometre inside 8 m, one at 8 m."""
    faces = spark.createDataFrame([(1, 1, 0.0, 0.0, 30.0), (2, 2, 0.0, 0.0, 30.0)], "scene_id long, face_id long, cx double, cz double, pitch double")
    segments = spark.createDataFrame([(1, 7, 8.0 - 2e-10, 0.0, 10.0, 20.0), (2, 8, 8.0, 0.0, 10.0, 20.0)], "scene_id long, segment_id long, x double, z double, pitch double, area double")
    return rules.match_segments(faces, segments)


def test_match_just_inside(spark):
    got = {r.face_id: r for r in matched(spark).collect()}
    assert (got[1].segment_id, got[1].gap, got[1].match_confidence) == (7, 8.0, 0.0)
    assert got[2].segment_id is None


def test_cross_check_counts_just_inside(spark):
    got = {r.scene_id: r for r in rules.cross_check(matched(spark)).collect()}
    assert (got[1].matched, got[1].reason) == (1, None) and (got[2].matched, got[2].reason) == (0, "p9_build_unmatched")


def test_drape_upright(spark):
    """A plane at 89.8 degrees: its area is bounded on its own, and not where ``least_up`` is small."""
    from heliogable.operators import drape

    pts = spark.createDataFrame([(1, k, 0.001 * (k % 5), 0.3 * (k % 5), 0.5 * (k // 5)) for k in range(20)], "scene_id long, pid long, x double, y double, z double")
    seg = spark.createDataFrame([(1, 2, 2, [-1.0, 1.0, 1.0, -1.0], [-1.0, -1.0, 3.0, 3.0], 0.8)], "scene_id long, face_id long, place long, xs array<double>, zs array<double>, confidence double")
    assert drape.drape(pts, seg).first().area == pytest.approx(800)
    assert drape.drape(pts, seg, least_up=1e-300).first().area == pytest.approx(8 * np.hypot(300, 1), rel=1e-6)


@pytest.mark.parametrize("flat", [True, False])
def test_near_pairs_without_copies(spark, flat, monkeypatch):
    """Against brute force over many tiles; a point is shuffled to few of them, where a cell each side made 9 or 27 copies."""
    monkeypatch.setattr(points, "TILE", 3)
    monkeypatch.setattr(points, "BATCH", 50)
    rng = np.random.default_rng(5)
    cloud = [(s, 10 * k, *map(float, np.round(rng.uniform(-4, 4, 3), 2))) for s in (1, 2) for k in range(150)]
    df = spark.createDataFrame(cloud, "scene_id long, pid long, x double, y double, z double")
    gap = lambda p, q: np.sqrt(sum((p[k] - q[k]) ** 2 for k in ((2, 4) if flat else (2, 3, 4))))
    close = {(p[0], p[1], q[1]) for p in cloud for q in cloud if p[0] == q[0] and gap(p, q) <= 1}
    got = [tuple(r)[:3] for r in points.near_pairs(df, df, 1.0, flat).collect()]
    assert len(got) == len(set(got)) and set(got) == close
    some, rest = df.filter("pid % 20 = 0").withColumn("w", F.lit(1.0)), df.withColumn("w", F.lit(1.0))
    got = [tuple(r)[:3] for r in points.near_pairs(some, rest, "w", flat).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k in close if k[1] % 20 == 0}
    got = [tuple(r)[:3] for r in points.radius_pairs(df, 1.0, flat).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k in close if k[1] < k[2]}
    monkeypatch.setattr(points, "TILE", 64)
    assert points._tiles(df, F.lit(1.0)).count() == df.count()


def test_ray_beside_an_edge(spark):
    """A ray half a micrometre outside a triangle misses it, one through the edge that two share hits."""
    from heliogable.operators import shading

    v = lambda x, y, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z"))
    hit = lambda x, y, z, *t: shading.hits_triangle(v(x, y, z), v(0, 0, 1), *[v(*p) for p in t])
    one, two = ((0, 0, 5), (1, 0, 5), (1, 1, 5)), ((0, 0, 5), (1, 1, 5), (0, 1, 5))
    got = spark.range(1).select(hit(0.5, -5e-7, 0, *one).alias("beside"), hit(0.5, 5e-7, 0, *one).alias("inside"), (hit(0.3, 0.3, 0, *one) | hit(0.3, 0.3, 0, *two)).alias("between")).first()
    assert tuple(got) == (False, True, True)


def test_overlaps_never_broadcast(spark):
    """Masks exploded from a small table look small; each region pair's pixels are counted, and no join takes a side to the driver."""
    from heliogable.operators import image

    regions = spark.createDataFrame([(1, k, k % 7, k % 5) for k in range(40)] + [(2, 99, 0, 0)], "roof_id long, region_id long, x int, z int")
    masks = regions.select("roof_id", "region_id", F.explode(F.sequence(F.col("z"), F.col("z") + 2)).alias("row"), "x").select("roof_id", "region_id", "row", F.explode(F.sequence(F.col("x"), F.col("x") + 3)).alias("col"))
    df = image.overlaps(masks)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    px = {k: {(k % 5 + i, k % 7 + j) for i in range(3) for j in range(4)} for k in range(40)}
    want = {(p, q): len(px[p] & px[q]) for p in px for q in px if p < q and px[p] & px[q]}
    assert {(r.p, r.q): r.shared for r in df.collect()} == want
    assert all(r.n_p == r.n_q == 12 and r.iou == r.shared / (24 - r.shared) for r in df.collect())


def test_counts_and_links_in_tiles(spark, monkeypatch):
    """Counts and linked names over many tiles against brute force."""
    monkeypatch.setattr(points, "TILE", 3)
    monkeypatch.setattr(points, "BATCH", 50)
    rng = np.random.default_rng(6)
    cloud = [(s, k, *map(float, np.round(rng.uniform(-4, 4, 3), 2)), k % 50) for s in (1, 2) for k in range(200)]
    df = spark.createDataFrame(cloud, "scene_id long, pid long, x double, y double, z double, name long").withColumn("w", F.lit(1.0))
    gap = lambda p, q, axes: np.sqrt(sum((p[k] - q[k]) ** 2 for k in axes))
    for radius, flat, axes in ((1.0, True, (2, 4)), ("w", False, (2, 3, 4))):
        want = {(p[0], p[1]): sum(p[0] == q[0] and gap(p, q, axes) <= 1 for q in cloud) for p in cloud}
        assert {(r.scene_id, r.pid): r.near for r in points.near_counts(df, radius, flat).collect()} == want
    want = {(p[0], p[5], q[5]) for p in cloud for q in cloud if p[0] == q[0] and p[5] < q[5] and gap(p, q, (2, 4)) <= 1}
    assert {tuple(r) for r in points.near_links(df, 1.0, "name").collect()} == want


def test_no_ray_is_a_row(spark, monkeypatch):
    """Stopped rays and light over many tiles and blocks against each ray with each occluder; the query's plan deals out pixels, no rays."""
    from heliogable.operators import shading
    from heliogable.plans import shading as plans

    monkeypatch.setattr(shading, "TILE", 7.0)
    monkeypatch.setattr(shading, "BLOCK", 3)
    monkeypatch.setattr(shading, "BATCH", 4)
    corner = lambda x, y, z: {"x": float(x), "y": float(y), "z": float(z)}
    sections = spark.createDataFrame(
        [(s, 10 * s + k, [corner(5 * k, 3, 0), corner(5 * k + 4, 3, 0), corner(5 * k + 4, 3 + k, 5), corner(5 * k, 3 + k, 5)], 1.0) for s in (1, 2) for k in range(3)],
        "scene_id long, section_id long, corners array<struct<x:double,y:double,z:double>>, resolution double",
    )
    outline = [0.0, 1.3, 1.4, 0.6, 0.0], [0.0, 0.0, 1.2, 0.5, 1.1]  # not convex
    prisms = spark.createDataFrame(
        [(1, k, [x + 4 * k for x in outline[0]], [z + 2 for z in outline[1]], 7.0, 2.0, 11 if k == 1 else None) for k in range(4)] + [(2, 9, [0.0, 1.0], [0.0, 1.0], 0.0, 9.0, None)],
        "scene_id long, obstruction_id long, xs array<double>, zs array<double>, base_y double, top_y double, owner_id long",
    )
    trees = spark.createDataFrame([(1, 2.0, 9.0, 0.0, 9.0, 1.5), (2, 60.0, 40.0, 0.0, 70.0, 6.0), (2, None, 1.0, 0.0, 9.0, 1.0)], "scene_id long, x double, z double, base_y double, peak_y double, radius double")
    lat, lng, samples, c = 42.35, -71.05, 24, F.col
    framed = shading.frames(sections)
    px = shading.pixels(framed).join(framed.select("scene_id", "section_id", "nx", "ny", "nz"), ["scene_id", "section_id"])
    ray = px.join(shading.sun_samples(spark, lat, lng, samples).filter("dni > 0")).withColumn("aoi", c("d.x") * c("nx") + c("d.y") * c("ny") + c("d.z") * c("nz")).filter("aoi > 0")
    ray = ray.withColumns({"o": shading._v(*[c(a) + shading.LIFT * c(f"n{a}") for a in "xyz"]), "beam": c("dni") * c("aoi") * c("weight")}).cache()
    keys = ["scene_id", "section_id", "row", "col", "sample"]
    tri = shading.triangles(prisms).join(prisms.select("scene_id", "obstruction_id", "owner_id"), ["scene_id", "obstruction_id"])
    by_prism = ray.join(tri.withColumnRenamed("c", "e"), "scene_id").filter(shading.hits_triangle(c("o"), c("d"), c("a"), c("b"), c("e")) & ~F.coalesce(c("owner_id") == c("section_id"), F.lit(False))).select(*keys).distinct()
    by_tree = ray.select(*keys, "o", "d").join(trees.withColumnsRenamed({"x": "bx", "z": "bz"}), "scene_id").filter(shading.hits_ellipsoid(c("o"), c("d"), shading._v(c("bx"), (c("base_y") + c("peak_y")) / 2, c("bz")), shading._v(c("radius"), (c("peak_y") - c("base_y")) / 2, c("radius")))).select(*keys).distinct()
    count = lambda df: {tuple(r) for r in df.groupBy("scene_id", "section_id", "sample").agg(F.count("*")).collect()}
    for want, use in ((by_prism, (prisms, None)), (by_tree, (None, trees)), (by_prism.union(by_tree).distinct(), (prisms, trees))):
        found = count(want)
        assert len(found) > 10 and {tuple(r) for r in shading.stopped_rays(spark, sections, *use, lat, lng, samples).collect()} == found
    out = shading.exclude_footprints(px, prisms.select("scene_id", "xs", "zs")).select(*keys[:4])
    open_ = {tuple(r)[:4]: r.kwh_m2 for r in shading.bake(spark, sections, None, None, lat, lng, "none", samples).collect()}
    for mode, dark in (("trees", by_tree), ("obstructions", by_prism), ("both", by_prism.union(by_tree).distinct())):
        lost = {tuple(r)[:4]: r.lost for r in ray.join(dark, keys).groupBy(*keys[:4]).agg(F.sum("beam").alias("lost")).collect()}
        want = {k: open_[k] - lost.get(k, 0) / 1000 for k in map(tuple, out.collect())}
        got = {tuple(r)[:4]: r.kwh_m2 for r in shading.bake(spark, sections, prisms, trees, lat, lng, mode, samples).collect()}
        assert got.keys() == want.keys() < open_.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(plans, "bridge", lambda *a: spark.createDataFrame([(6, 1, 0.0, 5.0, 0.0, 4.6, 30.0, 1.0)], "face_id long, scene_id long, x0 double, x1 double, z0 double, z1 double, pitch double, elevation double"))
    for name in (plans.ray_ellipsoid_hits, plans.ray_triangle_hits, plans.per_pixel_bake):
        plan = name(spark, "")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join Inner" not in plan.split("FlatMapCoGroupsInArrow")[0]
