"""Roof planes as a graph: adjacency, typed edges, components, dormers, obstructions, confidence.

A plane is a row (scene_id, face_id, xs, zs, pitch, azimuth, height, elevation,
confidence); ``azimuth`` counts from +z (south) towards +x, as the plane builders
do; ``compass`` turns it into degrees from north.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import clip, first_true, in_polygon, num, shoelace

CLOSE, SHORTEST = 1.0, 0.5
REVIEW = 0.6


def compass(azimuth: Column) -> Column:
    return F.pmod(180 - azimuth, num(360))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, num(0), lambda a, v: a + v) / F.size(values)


def complete(planes: DataFrame) -> DataFrame:
    """With area, centre, sides, flatness, type and plane equation a, b, c, d."""
    c = F.col
    df = planes.withColumns({"area": shoelace(c("xs"), c("zs")), "cx": mean_of(c("xs")), "cz": mean_of(c("zs")), "width": F.array_max("xs") - F.array_min("xs"), "depth": F.array_max("zs") - F.array_min("zs")})
    df = df.withColumns({"is_flat": (c("pitch") < 5) & (F.least("width", "depth") >= 2), "needs_review": c("confidence") < REVIEW})
    kind = first_true(((c("area") < 5) & (c("elevation") > 2), "dormer"), ((c("area") < 15) & (c("height") < 3), "porch"), ((c("area") < 30) & (c("elevation") < 1.5), "garage"), default="main")
    p, az = F.radians("pitch"), F.radians("azimuth")
    df = df.withColumns({"plane_type": kind, "a": F.sin(p) * F.sin(az), "b": F.cos(p), "c": F.sin(p) * F.cos(az)})
    return df.withColumn("d", -(c("a") * c("cx") + c("b") * (c("height") + c("elevation")) / 2 + c("c") * c("cz")))


def height_at(x: Column, z: Column, p: str = "") -> Column:
    """Height of a plane over a point; its own height where it stands upright."""
    a, b, c, d, h = (F.col(p + k) for k in ("a", "b", "c", "d", "height"))
    upright = F.abs(b) <= 1e-10
    return F.when(upright, h).otherwise(-(a * x + c * z + d) / F.when(upright, num(1)).otherwise(b))


def vertices(planes: DataFrame) -> DataFrame:
    return planes.select("scene_id", "face_id", F.posexplode(F.arrays_zip("xs", "zs")).alias("i", "v")).select("scene_id", "face_id", "i", F.col("v.xs").alias("x"), F.col("v.zs").alias("z"))


def adjacency(planes: DataFrame, close: float = CLOSE, shortest: float = SHORTEST) -> DataFrame:
    """Pairs p < q of a scene's planes that share an edge: its ends (x0, z0), (x1, z1) and length.

    Vertex pairs nearer than ``close`` meet through cells of that width; of their
    midpoints the two farthest apart are the edge (ties: the first in vertex order).
    """
    v = vertices(planes).withColumns({"gx": F.floor(F.col("x") / close), "gz": F.floor(F.col("z") / close)})
    near = v.withColumn("gx", F.explode(F.array(F.col("gx") - 1, F.col("gx"), F.col("gx") + 1))).withColumn("gz", F.explode(F.array(F.col("gz") - 1, F.col("gz"), F.col("gz") + 1)))
    a, b = near.alias("a"), v.alias("b")
    gap = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.z") - F.col("b.z")) ** 2)
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("scene_id", "gx", "gz")]).filter((F.col("a.face_id") < F.col("b.face_id")) & (gap < close))
    mid = F.struct(F.col("a.i").alias("i"), F.col("b.i").alias("j"), ((F.col("a.x") + F.col("b.x")) / 2).alias("x"), ((F.col("a.z") + F.col("b.z")) / 2).alias("z"))
    both = met.groupBy(F.col("a.scene_id").alias("scene_id"), F.col("a.face_id").alias("p"), F.col("b.face_id").alias("q")).agg(F.array_sort(F.collect_list(mid)).alias("m"))
    m = F.col("m")
    ways = F.flatten(F.transform(m, lambda s, k: F.transform(F.slice(m, k + 2, F.size(m)), lambda t: F.struct((-F.sqrt((s["x"] - t["x"]) ** 2 + (s["z"] - t["z"]) ** 2)).alias("w"), s.alias("s"), t.alias("t")))))
    best = both.filter(F.size(m) >= 2).withColumn("best", F.array_min(ways))
    return best.select("scene_id", "p", "q", F.col("best.s.x").alias("x0"), F.col("best.s.z").alias("z0"), F.col("best.t.x").alias("x1"), F.col("best.t.z").alias("z1"), (-F.col("best.w")).alias("length")).filter(F.col("length") >= shortest)


def _pair(edges: DataFrame, planes: DataFrame) -> DataFrame:
    """Edges with both planes' columns, prefixed p_ and q_."""
    for side in "pq":
        own = planes.select("scene_id", *[F.col(c).alias(f"{side}_{c}") for c in planes.columns if c != "scene_id"])
        edges = edges.join(own.withColumnRenamed(f"{side}_face_id", side), ["scene_id", side])
    return edges


def shared_edges(edges: DataFrame, planes: DataFrame) -> DataFrame:
    """Edges with heights, type, confidence and review flag."""
    c = F.col
    df = _pair(edges, planes)
    df = df.withColumns({"y0": height_at(c("x0"), c("z0"), "p_"), "y1": height_at(c("x1"), c("z1"), "p_"), "mx": (c("x0") + c("x1")) / 2, "mz": (c("z0") + c("z1")) / 2})
    dot = c("p_a") * c("q_a") + c("p_b") * c("q_b") + c("p_c") * c("q_c")
    size = lambda s: F.sqrt(c(f"{s}_a") ** 2 + c(f"{s}_c") ** 2)
    df = df.withColumns({"angle": F.degrees(F.acos(F.abs(clip(dot, -1, 1)))), "pn": size("p"), "qn": size("q"), "edge_y": (c("y0") + c("y1")) / 2})
    sloped = (c("pn") > 1e-6) & (c("qn") > 1e-6)
    facing = (c("p_a") * c("q_a") + c("p_c") * c("q_c")) / F.when(sloped, c("pn") * c("qn")).otherwise(num(1))
    away = lambda s, n: F.when(c(n) > 1e-6, (c(f"{s}_cx") - c("mx")) * c(f"{s}_a") + (c(f"{s}_cz") - c("mz")) * c(f"{s}_c") > 0).otherwise(F.lit(True))
    df = df.withColumns({"facing": F.when(sloped, F.degrees(F.acos(clip(F.abs(facing), 0, 1)))).otherwise(num(0)), "convex": away("p", "pn") & away("q", "qn"), "level": (c("p_height") + c("p_elevation") + c("q_height") + c("q_elevation")) / 4})
    low_flat = (c("p_is_flat") & (c("edge_y") < c("p_elevation") + 0.3)) | (c("q_is_flat") & (c("edge_y") < c("q_elevation") + 0.3))
    kind = first_true(
        (c("angle") < 10, "step_flash"), (low_flat, "step_flash"),
        (c("convex") & (c("edge_y") > c("level") + 0.3), F.when(c("facing") > 45, F.lit("hip")).otherwise(F.lit("ridge"))),
        (~c("convex") & (c("edge_y") < c("level") - 0.3), "valley"),
        (c("convex"), F.when(c("facing") > 30, F.lit("hip")).otherwise(F.lit("ridge"))),
        (c("edge_y") < c("level") - 0.1, "valley"), default="step_flash",
    )
    return df.select("scene_id", "p", "q", "x0", "y0", "z0", "x1", "y1", "z1", "length", kind.alias("edge_type"), F.least("p_confidence", "q_confidence").alias("confidence"), (c("p_needs_review") | c("q_needs_review")).alias("needs_review"))


def boundary_edges(planes: DataFrame, shared: DataFrame, near: float = 1.5) -> DataFrame:
    """Sides of planes that aren't shared: eaves near the plane's foot, else rakes."""
    c = F.col
    n = F.size("xs")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get("xs", i).alias("x0"), F.get("zs", i).alias("z0"), F.get("xs", (i + 1) % n).alias("x1"), F.get("zs", (i + 1) % n).alias("z1")))
    df = planes.select("scene_id", "face_id", "a", "b", "c", "d", "height", "elevation", "confidence", F.inline(sides))
    df = df.withColumns({"mx": (c("x0") + c("x1")) / 2, "mz": (c("z0") + c("z1")) / 2, "y0": height_at(c("x0"), c("z0")), "y1": height_at(c("x1"), c("z1"))})
    own = shared.select("scene_id", F.explode(F.array("p", "q")).alias("face_id"), ((c("x0") + c("x1")) / 2).alias("sx"), ((c("z0") + c("z1")) / 2).alias("sz")).alias("s")
    e = df.alias("e")
    on = (c("e.scene_id") == c("s.scene_id")) & (c("e.face_id") == c("s.face_id")) & (F.sqrt((c("e.mx") - c("s.sx")) ** 2 + (c("e.mz") - c("s.sz")) ** 2) < near)
    free = e.join(own, on, "left_anti").withColumn("length", F.sqrt((c("x1") - c("x0")) ** 2 + (c("y1") - c("y0")) ** 2 + (c("z1") - c("z0")) ** 2)).filter("length >= 0.2")
    kind = F.when((c("y0") + c("y1")) / 2 < c("elevation") + 0.5, F.lit("eave")).otherwise(F.lit("rake"))
    return free.select("scene_id", "face_id", "i", "x0", "y0", "z0", "x1", "y1", "z1", "length", kind.alias("edge_type"), (c("confidence") * 0.9).alias("confidence"))


def intersections(edges: DataFrame) -> DataFrame:
    """Points where ends of edges (scene_id, edge_id, x0 .. z1) meet, to a tenth of a metre."""
    ends = edges.select("scene_id", "edge_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z")))).alias("p"))
    keyed = ends.select("scene_id", "edge_id", "p.*", *[F.bround(F.round(f"p.{k}", 6), 1).alias(f"k{k}") for k in "xyz"])
    met = keyed.groupBy("scene_id", "kx", "ky", "kz").agg(F.count("*").alias("n"), F.countDistinct("edge_id").alias("edges"), *[F.avg(k).alias(k) for k in "xyz"]).filter("n >= 2")
    kind = F.when((F.col("edges") >= 3) | (F.round("y", 3) > 2), F.lit("peak")).otherwise(F.lit("corner"))
    return met.select("scene_id", "x", "y", "z", "n", "edges", kind.alias("kind"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, node, label) with the smallest node that each hangs together with, inside one scene.

    Scenes hold tens of planes, so each is one small group.
    """
    link = edges.select("scene_id", F.col("p").alias("a"), F.col("q").alias("b"))
    link = link.union(link.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b"))).union(nodes.select("scene_id", F.col("node").alias("a"), F.col("node").alias("b"))).distinct()

    def one(graph):
        label = {n: n for n in graph["a"]}
        pairs = list(zip(graph["a"], graph["b"], strict=True))

        def root(n):
            while label[n] != n:
                label[n] = label[label[n]]
                n = label[n]
            return n

        for a, b in pairs:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
        nodes = sorted(label)
        return pd.DataFrame({"scene_id": graph["scene_id"].iloc[0], "node": nodes, "label": [root(n) for n in nodes]})

    return link.groupBy("scene_id").applyInPandas(one, "scene_id long, node long, label long")


def dormers(planes: DataFrame, edges: DataFrame) -> DataFrame:
    """Small raised planes beside one more than twice as large, with the five points of their outline."""
    c = F.col
    both = edges.select("scene_id", F.col("p").alias("face_id"), F.col("q").alias("other")).union(edges.select("scene_id", F.col("q"), F.col("p")))
    small = planes.filter("area <= 10 and elevation >= 1 and width >= 0.3 and depth >= 0.3")
    parent = planes.select("scene_id", c("face_id").alias("other"), c("area").alias("other_area"), c("xs").alias("pxs"), c("zs").alias("pzs"))
    df = small.join(both, ["scene_id", "face_id"]).join(parent, ["scene_id", "other"]).filter("other_area > 2 * area")
    first = df.groupBy("scene_id", "face_id").agg(F.min_by(F.struct("other", "pxs", "pzs", *[x for x in planes.columns if x not in ("scene_id", "face_id")]), "other").alias("r")).select("scene_id", "face_id", "r.*")
    az = F.radians("azimuth")
    df = first.withColumns({"fx": F.sin(az), "fz": F.cos(az)}).withColumn("at", c("cx") * c("fx") + c("cz") * c("fz"))
    along = lambda xs, zs: F.transform(F.arrays_zip(c(xs).alias("x"), c(zs).alias("z")), lambda v: v["x"] * c("fx") + v["z"] * c("fz"))
    df = df.withColumns({"front": F.array_max(along("pxs", "pzs")) - c("at"), "back": c("at") - F.array_min(along("xs", "zs"))})
    df = df.withColumns({"front": F.when(c("front") <= 0, c("depth") / 2).otherwise(c("front")), "back": F.when(c("back") <= 0, c("depth") / 2).otherwise(c("back"))})
    kind = first_true((c("pitch") > 20, "gable"), (c("pitch") > 5, "hip"), default="shed")

    def point(dx, dz):
        return F.struct((c("cx") - c("fz") * dx + c("fx") * dz).alias("x"), (c("elevation") + F.greatest(num(0), -dz) * F.tan(F.radians("pitch"))).alias("y"), (c("cz") + c("fx") * dx + c("fz") * dz).alias("z"))

    half = c("width") / 2
    outline = F.array(point(half, c("front")), point(-half, c("front")), point(-half, -c("back")), point(num(0), -c("back")), point(half, -c("back")))
    return df.select("scene_id", "face_id", c("other").alias("parent_id"), kind.alias("dormer_type"), "cx", "cz", "width", (c("front") + c("back")).alias("depth"), F.greatest(c("height") - c("elevation"), num(0.1)).alias("height"), "confidence", outline.alias("outline"))


def obstructions(planes: DataFrame, labels: DataFrame) -> DataFrame:
    """Planes of up to 4 m2 that hang together with nothing, by size and shape."""
    c = F.col
    alone = labels.groupBy("scene_id", "label").agg(F.count("*").alias("n")).filter("n = 1").select("scene_id", c("label").alias("face_id"))
    df = planes.join(alone, ["scene_id", "face_id"], "left_semi").filter("area <= 4").withColumn("aspect", F.greatest("width", "depth") / F.greatest(F.least("width", "depth"), num(0.01)))
    kind = first_true((c("area") < 0.3, "pipe"), ((c("area") < 1) & (c("aspect") < 2), "vent"), (c("aspect") < 2, "chimney"), (c("is_flat") & (c("area") > 1), "skylight"), default="unknown")
    return df.select("scene_id", "face_id", kind.alias("obstruction_type"), "area", "aspect", (c("height") - c("elevation")).alias("height"), (c("confidence") * 0.7).alias("confidence"))


def lower_roofs(planes: DataFrame, labels: DataFrame, edges: DataFrame, below: float = 1.5) -> DataFrame:
    """Planes more than 1.5 m under the largest of their component (ties: the smaller id), but for those that share a ridge or hip with it."""
    c = F.col
    df = planes.join(labels.withColumnRenamed("node", "face_id"), ["scene_id", "face_id"])
    top = df.groupBy("scene_id", "label").agg(F.max_by(F.struct("face_id", "height"), F.struct("area", -c("face_id"))).alias("top")).select("scene_id", "label", c("top.face_id").alias("largest"), c("top.height").alias("level"))
    high = edges.filter(c("edge_type").isin("ridge", "hip"))
    partners = high.select("scene_id", c("p").alias("face_id"), c("q").alias("largest")).union(high.select("scene_id", c("q"), c("p")))
    low = df.join(top, ["scene_id", "label"]).filter((c("face_id") != c("largest")) & (F.round(c("level") - c("height"), 9) > below))
    return low.join(partners, ["scene_id", "face_id", "largest"], "left_anti").select("scene_id", "face_id", "largest")


def plane_scores(planes: DataFrame, edges: DataFrame) -> DataFrame:
    """Planes with score: neighbours add, small and flat ones lose."""
    c = F.col
    degree = edges.select("scene_id", F.explode(F.array("p", "q")).alias("face_id")).groupBy("scene_id", "face_id").agg(F.count("*").alias("degree"))
    df = planes.join(degree, ["scene_id", "face_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    score = F.least(num(1), c("confidence") + F.least(num(0.1), c("degree") * num(0.03)))
    score = score * F.when(c("area") < 3, num(0.85)).otherwise(num(1)) * F.when(c("is_flat") & (c("area") < 10), num(0.9)).otherwise(num(1))
    return df.withColumn("score", score).withColumn("review", F.round("score", 9) < REVIEW)


def edge_scores(edges: DataFrame) -> DataFrame:
    score = first_true((F.col("length") > 3, F.least(num(1), F.col("confidence") + num(0.05))), (F.col("length") < 0.5, F.col("confidence") * num(0.8)), default=F.col("confidence"))
    return edges.withColumn("score", score).withColumn("review", F.round("score", 9) < REVIEW)


def overall(planes: DataFrame, edges: DataFrame) -> DataFrame:
    """scene_id, overall: planes count twice, each review takes its share of 0.3."""
    both = planes.select("scene_id", num(2).alias("w"), "score", "review").union(edges.select("scene_id", num(1).alias("w"), "score", "review"))
    score = F.sum(F.col("w") * F.col("score")) / F.sum("w") * (1 - num(0.3) * F.count_if("review") / F.count("*"))
    return both.groupBy("scene_id").agg(clip(score, 0, 1).alias("overall"))


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of boxes (x0, x1, z0, z1) under two aliases; 0 without area."""
    c = lambda s, k: F.col(f"{s}.{k}")
    over = F.greatest(num(0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))) * F.greatest(num(0), F.least(c(a, "z1"), c(b, "z1")) - F.greatest(c(a, "z0"), c(b, "z0")))
    each = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "z1") - c(s, "z0"))
    union = each(a) + each(b) - over
    return F.when(union > 0, over / F.when(union > 0, union).otherwise(num(1))).otherwise(num(0))


def fuse(planes: DataFrame, contours: DataFrame, least: float = 0.15) -> DataFrame:
    """Planes with their best contour (by box overlap), planes without, and contours that no plane took.

    Matched planes gain 0.2 of the overlap, unmatched ones keep 0.8 and go to
    review, contours of 3 m2 or more become flat planes of 0.6.
    """
    a, b = planes.alias("a"), contours.alias("b")
    iou = box_iou("a", "b")
    pairs = a.join(b, F.col("a.scene_id") == F.col("b.scene_id")).select(F.col("a.scene_id"), "a.face_id", "b.contour_id", iou.alias("iou")).filter(F.col("iou") > least)
    best = pairs.groupBy("scene_id", "face_id").agg(F.min_by(F.struct("contour_id", "iou"), F.struct(-F.col("iou"), F.col("contour_id"))).alias("m")).select("scene_id", "face_id", "m.contour_id", "m.iou")
    matched = planes.join(best, ["scene_id", "face_id"]).select("scene_id", "face_id", "contour_id", F.lit("fused").alias("source"), F.least(num(1), F.col("confidence") + num(0.2) * F.col("iou")).alias("confidence"), F.lit(False).alias("review"))
    alone = planes.join(best, ["scene_id", "face_id"], "left_anti").select("scene_id", "face_id", F.lit(None).cast("long").alias("contour_id"), F.lit("lidar").alias("source"), (F.col("confidence") * num(0.8)).alias("confidence"), F.lit(True).alias("review"))
    area = (F.col("x1") - F.col("x0")) * (F.col("z1") - F.col("z0"))
    rest = contours.join(best.select("scene_id", "contour_id").distinct(), ["scene_id", "contour_id"], "left_anti").filter(area >= 3).select("scene_id", F.lit(None).cast("long").alias("face_id"), "contour_id", F.lit("image").alias("source"), (F.col("confidence") * num(0.6)).alias("confidence"), F.lit(True).alias("review"))
    return matched.unionByName(alone).unionByName(rest)


def nearest_on_segments(points: DataFrame, segments: DataFrame, within: float = 0.5) -> DataFrame:
    """Points (scene_id, pid, x, z) with the nearest point on their scene's segments, where it is nearer than ``within``."""
    c = F.col
    df = points.join(segments.select("scene_id", "segment_id", "x0", "z0", "x1", "z1"), "scene_id")
    dx, dz = c("x1") - c("x0"), c("z1") - c("z0")
    size = dx * dx + dz * dz
    t = clip(((c("x") - c("x0")) * dx + (c("z") - c("z0")) * dz) / F.when(size > 1e-12, size).otherwise(num(1)), 0, 1)
    df = df.withColumn("t", F.when(size > 1e-12, t).otherwise(num(0))).withColumns({"nx": c("x0") + c("t") * dx, "nz": c("z0") + c("t") * dz})
    df = df.withColumn("gap", F.sqrt((c("x") - c("nx")) ** 2 + (c("z") - c("nz")) ** 2)).filter(c("gap") < within)
    return df.groupBy("scene_id", "pid").agg(F.min_by(F.struct("segment_id", "nx", "nz", "gap"), F.struct(F.round("gap", 9), "segment_id")).alias("m")).select("scene_id", "pid", "m.*")


def iou_match(faces: DataFrame, contours: DataFrame, least: float = 0.15) -> DataFrame:
    """(scene_id, face_id, contour_id, iou): of each face, the contour whose box overlaps its own most, by more than ``least`` of the union; ties to the smaller contour."""
    c = lambda side, name: F.col(f"{side}.{name}")
    a, b = faces.alias("a"), contours.alias("b")
    overlap = [F.least(c("a", f"{k}1"), c("b", f"{k}1")) - F.greatest(c("a", f"{k}0"), c("b", f"{k}0")) for k in "xz"]
    size = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "z1") - c(s, "z0"))
    both = overlap[0] * overlap[1]
    pairs = a.join(b, (c("a", "scene_id") == c("b", "scene_id")) & (overlap[0] > 0) & (overlap[1] > 0)).select("a.scene_id", "a.face_id", "b.contour_id", (both / (size("a") + size("b") - both)).alias("iou"))
    return pairs.filter(F.col("iou") > least).groupBy("scene_id", "face_id").agg(F.min(F.struct((-F.col("iou")).alias("less"), "contour_id")).alias("m")).select("scene_id", "face_id", "m.contour_id", (-F.col("m.less")).alias("iou"))


def sisters(planes: DataFrame, turn: float = 20, slope: float = 10, rise: float = 1.5) -> DataFrame:
    """Pairs p < q of a scene that face away from each other at like pitch and height."""
    a, b = planes.alias("a"), planes.alias("b")
    off = F.abs(F.col("a.azimuth") - F.col("b.azimuth"))
    off = F.abs(F.least(off, 360 - off) - 180)
    on = (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.face_id") < F.col("b.face_id")) & (off <= turn) & (F.abs(F.col("a.pitch") - F.col("b.pitch")) <= slope) & (F.abs(F.col("a.height") - F.col("b.height")) <= rise)
    return a.join(b, on).select(F.col("a.scene_id"), F.col("a.face_id").alias("p"), F.col("b.face_id").alias("q"))


def structures(pairs: DataFrame) -> DataFrame:
    """(scene_id, face_id, structure) of paired faces: pairs in order hand on the first face's structure, else the second's, else a new one named after the first.

    The order matters (a face can be taken over while its earlier partners
    stay), so each scene's few pairs are folded one after another.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, int] = {}
        for p, q in sorted(zip(g["p"], g["q"], strict=True)):
            held[p] = held[q] = held.get(p, held.get(q, p))
        return pd.DataFrame({"scene_id": g["scene_id"].iloc[0], "face_id": list(held), "structure": list(held.values())})

    return pairs.groupBy("scene_id").applyInPandas(one, "scene_id long, face_id long, structure long")


def smallest_rectangle(polygons: DataFrame) -> DataFrame:
    """Of convex polygons, the smallest rectangle that lies along one of their sides: angle, length, breadth, area."""
    n = F.size("xs")
    side = lambda i: F.atan2(F.get("zs", (i + 1) % n) - F.get("zs", i), F.get("xs", (i + 1) % n) - F.get("xs", i))
    df = polygons.select("scene_id", "face_id", "xs", "zs", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), side)).alias("i", "angle"))
    turned = lambda f: F.transform(F.arrays_zip(F.col("xs").alias("x"), F.col("zs").alias("z")), f)
    u = turned(lambda v: v["x"] * F.cos("angle") + v["z"] * F.sin("angle"))
    w = turned(lambda v: v["z"] * F.cos("angle") - v["x"] * F.sin("angle"))
    df = df.withColumns({"du": F.array_max(u) - F.array_min(u), "dw": F.array_max(w) - F.array_min(w)})
    return df.groupBy("scene_id", "face_id").agg(F.min_by(F.struct("angle", "du", "dw"), F.struct(F.round(F.col("du") * F.col("dw"), 6), F.col("i"))).alias("m")).select("scene_id", "face_id", "m.angle", F.greatest("m.du", "m.dw").alias("length"), F.least("m.du", "m.dw").alias("breadth"), (F.col("m.du") * F.col("m.dw")).alias("area"))


# Colours of plane types in a CRM face.
COLOURS = {"main": "#4a90d9", "garage": "#7bc47f", "porch": "#d4a843", "walkway": "#999999", "dormer": "#c46b6b"}


def colour(kind: Column) -> Column:
    """Of a plane type; unknown and null ones are drawn as main."""
    return first_true(*[(kind == k, v) for k, v in COLOURS.items()], default=COLOURS["main"])


def rectangle_corners(rectangles: DataFrame) -> DataFrame:
    """Rectangles of ``smallest_rectangle`` over their polygons (xs, zs) with the four corners: array of (x, z), rounded to millimetres."""
    cos, sin = F.cos("angle"), F.sin("angle")
    turned = lambda f: F.transform(F.arrays_zip(F.col("xs").alias("x"), F.col("zs").alias("z")), f)
    u, w = turned(lambda v: v["x"] * cos + v["z"] * sin), turned(lambda v: v["z"] * cos - v["x"] * sin)
    df = rectangles.withColumns({"u0": F.array_min(u), "u1": F.array_max(u), "w0": F.array_min(w), "w1": F.array_max(w)})
    at = lambda a, b: F.struct(F.round(F.col(a) * cos - F.col(b) * sin, 3).alias("x"), F.round(F.col(a) * sin + F.col(b) * cos, 3).alias("z"))
    return df.withColumn("corners", F.array(at("u0", "w0"), at("u1", "w0"), at("u1", "w1"), at("u0", "w1"))).drop("u0", "u1", "w0", "w1")


def crm_faces(planes: DataFrame, dormers: DataFrame) -> DataFrame:
    """Planes as the CRM's faces: a rectangle of four corners, the pitch of each section, a colour and the dormers on it in order of their ids.

    Dormers are (scene_id, face_id, parent_id, ..); all their other columns go
    into the nested rows.  A plane without any has an empty list.
    """
    rest = [c for c in dormers.columns if c not in ("scene_id", "face_id", "parent_id")]
    own = dormers.select("scene_id", F.col("parent_id").alias("face_id"), F.struct(F.col("face_id").alias("id"), *rest).alias("d")).groupBy("scene_id", "face_id").agg(F.array_sort(F.collect_list("d"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("dormers"))
    found = rectangle_corners(smallest_rectangle(planes).join(planes.select("scene_id", "face_id", "xs", "zs"), ["scene_id", "face_id"])).select("scene_id", "face_id", "corners")
    df = planes.join(found, ["scene_id", "face_id"]).join(own, ["scene_id", "face_id"], "left")
    df = df.withColumn("dormers", F.coalesce("dormers", F.array().cast(own.schema["dormers"].dataType)))
    return df.select("scene_id", "face_id", "corners", "pitch", F.array_repeat("pitch", 4).alias("section_pitches"), "azimuth", F.coalesce("elevation", num(0)).alias("height"), colour(F.col("plane_type")).alias("color"), F.array_repeat(F.lit(False), 4).alias("deleted_sections"), "dormers")


def largest_planes(planes: DataFrame, most: int = 20) -> DataFrame:
    """A scene's ``most`` planes of largest area, ranked; ties to the smaller face_id."""
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("area"), "face_id"))
    return planes.withColumn("rank", rank).filter(F.col("rank") <= most)


def points_in(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(scene_id, pid, face_id) of points inside polygons of their scene, boxes first."""
    box = polygons.select("scene_id", "face_id", "xs", "zs", F.array_min("xs").alias("bx0"), F.array_max("xs").alias("bx1"), F.array_min("zs").alias("bz0"), F.array_max("zs").alias("bz1"))
    df = points.join(box, "scene_id").filter("x >= bx0 and x <= bx1 and z >= bz0 and z <= bz1")
    return df.filter(in_polygon(F.col("x"), F.col("z"), F.col("xs"), F.col("zs"))).select("scene_id", "pid", "face_id")
