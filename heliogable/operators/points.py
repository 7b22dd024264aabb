"""Point clouds: from raw coordinates to clean, thinned, gridded clouds.

A cloud is a table (scene_id, pid, x, y, z), y up.  A scene is one building, so
scenes are many and small; neighbour searches go through a grid of cells as wide
as the radius, an equi-join on cells that spreads over the cluster.
"""

from __future__ import annotations

from functools import reduce
from math import cos, radians

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import clip, num
from heliogable.operators.graph import components
from heliogable.sources.tables import keep

METRES_PER_DEGREE = 111_320.0
_SCENE = ("scene_id",)


def geo_to_local(points: DataFrame, lat: float, lng: float) -> DataFrame:
    """(lng, lat, elev) rows with x east, z south, y up in metres; rows without all three are dropped."""
    df = points.filter("lng is not null and lat is not null and elev is not null")
    return df.withColumns({"x": (F.col("lng") - lng) * num(METRES_PER_DEGREE * cos(radians(lat))), "z": -(F.col("lat") - lat) * num(METRES_PER_DEGREE), "y": F.col("elev")})


def focus_radius(anchors: DataFrame) -> DataFrame:
    """scene_id, radius: with two anchors or more the farthest's distance and 5 m, 12 m at least; else 10 m."""
    far = F.max(F.sqrt(F.col("x") ** 2 + F.col("z") ** 2))
    return anchors.groupBy("scene_id").agg(F.when(F.count("*") >= 2, F.greatest(far + 5, num(12))).otherwise(num(10)).alias("radius"))


def focus(points: DataFrame, radius: Column | float = 10.0, tx: float = 0.0, tz: float = 0.0) -> DataFrame:
    """Points within the radius of the scene's centre, then moved by the calibration offset."""
    radius = radius if isinstance(radius, Column) else num(radius)
    near = points.filter(F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")) <= radius)
    return near.withColumns({"x": F.col("x") + tx, "z": F.col("z") + tz}) if tx or tz else near


def affine(points: DataFrame, matrix: tuple[tuple[float, float, float], ...]) -> DataFrame:
    """x and z by a 2 x 3 matrix; y stays."""
    (a, b, c), (d, e, f) = matrix[:2]
    return points.withColumns({"x": num(a) * F.col("x") + num(b) * F.col("z") + num(c), "z": num(d) * F.col("x") + num(e) * F.col("z") + num(f)})


def procrustes(dots: DataFrame, keys: tuple[str, ...] = _SCENE) -> DataFrame:
    """Rotation, scale and shift that take (sx, sz) to (dx, dz), from sums alone: theta, scale, tx, tz, rmse.

    Under two dots the identity.
    """
    own = Window.partitionBy(*keys)
    df = dots.withColumns({f"c{c}": F.col(c) - F.avg(c).over(own) for c in ("sx", "sz", "dx", "dz")})
    h = {f"h{i}{j}": F.sum(F.col(f"cs{'xz'[i]}") * F.col(f"cd{'xz'[j]}")) for i in (0, 1) for j in (0, 1)}
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in h.items()], F.sum(F.col("csx") ** 2 + F.col("csz") ** 2).alias("var"), *[F.avg(c).alias(f"m{c}") for c in ("sx", "sz", "dx", "dz")])
    # det(R) = sign of det(H) in the reference's sense: the reflected case keeps the singular values' sum.
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h10")
    reach = F.sqrt(F.col("h00") ** 2 + F.col("h01") ** 2 + F.col("h10") ** 2 + F.col("h11") ** 2 + 2 * F.abs(det))
    many = F.col("n") >= 2
    sums = sums.withColumns({"theta": F.when(many, F.atan2(F.col("h01") - F.col("h10"), F.col("h00") + F.col("h11"))).otherwise(num(0)), "scale": F.when(many & (F.col("var") > 1e-12), reach / F.when(F.col("var") > 1e-12, F.col("var")).otherwise(num(1))).otherwise(num(1))})
    sums = sums.withColumns({"tx": F.when(many, F.col("mdx") - F.col("scale") * (F.cos("theta") * F.col("msx") - F.sin("theta") * F.col("msz"))).otherwise(num(0)), "tz": F.when(many, F.col("mdz") - F.col("scale") * (F.sin("theta") * F.col("msx") + F.cos("theta") * F.col("msz"))).otherwise(num(0))})
    back = dots.join(sums.select(*keys, "n", "theta", "scale", "tx", "tz"), list(keys))
    ex = F.col("scale") * (F.cos("theta") * F.col("sx") - F.sin("theta") * F.col("sz")) + F.col("tx") - F.col("dx")
    ez = F.col("scale") * (F.sin("theta") * F.col("sx") + F.cos("theta") * F.col("sz")) + F.col("tz") - F.col("dz")
    return back.groupBy(*keys, "n", "theta", "scale", "tx", "tz").agg(F.sqrt(F.avg(ex * ex + ez * ez)).alias("rmse"))


def ground_heights(points: DataFrame) -> DataFrame:
    """scene_id, ground: the 5th percentile of height, interpolated."""
    return points.groupBy("scene_id").agg(F.percentile("y", 0.05).alias("ground"))


def remove_ground(points: DataFrame, above: float = 2.0) -> DataFrame:
    """Points more than ``above`` over their scene's ground, with heights over it."""
    return points.join(ground_heights(points), "scene_id").filter(F.col("y") > F.col("ground") + above).withColumn("y", F.col("y") - F.col("ground")).drop("ground")


_LISTS = "near array<struct<other:long,d:double,x:double,y:double,z:double>>"
_MOMENTS = [f"c{a}{b}" for k, a in enumerate("xyz") for b in "xyz"[k:]] + ["mx", "my", "mz", "h_std", "extent", "compactness", "nearest", "farthest", "mean_d"]


def _lists(own: np.ndarray, other: np.ndarray, d: np.ndarray, near: np.ndarray) -> dict:
    """``near`` of the found neighbours: ids and distances (points x n), places (3 x points x n)."""
    found = pa.StructArray.from_arrays([pa.array(c.ravel()) for c in (other, d, *near)], ["other", "d", "x", "y", "z"])
    return {"near": pa.ListArray.from_arrays(pa.array(np.arange(len(other) + 1) * other.shape[1], pa.int32()), found)}


def _moments(own: np.ndarray, other: np.ndarray, d: np.ndarray, near: np.ndarray) -> dict:
    """Covariances and extents of the neighbours and the point itself, summed about it."""
    off = np.concatenate([near - own[:, :, None], np.zeros((*own.shape, 1))], axis=2)
    mean = off.mean(axis=2)
    off = off - mean[:, :, None]
    cov = {f"c{a}{b}": (off[i] * off[j]).mean(axis=1) for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j}
    extent = off[1].max(axis=1) - off[1].min(axis=1)
    wide = np.sqrt((off[0] ** 2 + off[2] ** 2).max(axis=1))
    gaps = (d.min(axis=1), d.max(axis=1), d.mean(axis=1)) if d.shape[1] else [pa.nulls(len(d), pa.float64())] * 3
    values = [*cov.values(), *(mean + own), np.sqrt(cov["cyy"]), extent, extent / np.maximum(wide, 0.01), *gaps]
    return {"n": pa.array(np.full(len(d), d.shape[1] + 1)), **dict(zip(_MOMENTS, values, strict=True))}


def _tile_search(points: DataFrame, seekers: DataFrame | None, k: int, widen: float, shape, schema: str) -> DataFrame:
    """One round: each tile's own points against all points of the tile and a rim as wide as a quarter of it.

    A point is done where its k-th neighbour is nearer than the rim is wide, or
    where the tile holds the whole scene; ``shape`` turns its neighbours into
    columns.  The others come back with ``done`` false.
    """
    names = [f.split(" ")[0] for f in schema.split(", ")]
    own = points.groupBy("scene_id").agg(F.count("*").alias("all"), F.min("x").alias("x0"), F.min("z").alias("z0"), (F.max("x") - F.min("x")).alias("dx"), (F.max("z") - F.min("z")).alias("dz"))
    rim = num(widen) * F.greatest(F.sqrt(F.col("dx") * F.col("dz") * k / F.col("all")), (F.col("dx") + F.col("dz")) * k / F.col("all"), num(0.01))
    df = points.join(own.select("scene_id", "all", "x0", "z0", "dx", "dz", rim.alias("rim")), "scene_id")
    tile = lambda a, off: F.floor(F.least(F.greatest(F.col(a) - F.col(f"{a}0") + off * F.col("rim"), num(0)), F.col(f"d{a}")) / (4 * F.col("rim")))
    df = df.withColumns({"hx": tile("x", 0), "hz": tile("z", 0), "tx": F.explode(F.sequence(tile("x", -1), tile("x", 1)))}).withColumn("tz", F.explode(F.sequence(tile("z", -1), tile("z", 1))))
    df = df.withColumn("seeks", (F.col("tx") == F.col("hx")) & (F.col("tz") == F.col("hz"))).drop("hx", "hz", "x0", "z0", "dx", "dz")
    if seekers is not None:
        df = df.join(seekers.withColumn("late", F.lit(True)), ["scene_id", "pid"], "left").withColumn("seeks", F.col("seeks") & F.coalesce("late", F.lit(False))).drop("late")
        df = df.join(df.filter("seeks").select("scene_id", "tx", "tz").distinct(), ["scene_id", "tx", "tz"], "left_semi")

    def one(part: pa.Table) -> pa.Table:
        columns = {c: part[c].to_numpy() for c in ("pid", "x", "y", "z", "seeks")}
        order = np.argsort(columns["pid"])
        pid, xyz, out = columns["pid"][order], np.stack([columns[c][order] for c in "xyz"]), []
        mine = np.flatnonzero(columns["seeks"][order])
        scene, n, whole, reach = part["scene_id"][0].as_py(), min(k, len(pid) - 1), len(pid) == part["all"][0].as_py(), (part["rim"][0].as_py() * (1 - 1e-9)) ** 2
        for a in range(0, len(mine), 256):
            at = mine[a : a + 256]
            d2 = sum((axis[at, None] - axis[None, :]) ** 2 for axis in xyz)
            d2[np.arange(len(at)), at] = np.inf
            last = np.partition(d2, n - 1, axis=1)[:, n - 1] if n else np.full(len(at), np.inf)
            done = np.full(len(at), True) if whole else (last < reach) & (n == k)
            row, col = np.nonzero((d2 <= last[:, None]) & done[:, None] & np.isfinite(d2))
            by = np.lexsort((col, d2[row, col], row))
            row, col = row[by], col[by]
            first = np.arange(len(row)) - np.searchsorted(row, row) < n
            col, at, left = col[first].reshape(-1, n) if n else np.empty((done.sum(), 0), int), at[done], at[~done]
            got = shape(xyz[:, at], pid[col], np.sqrt(((xyz[:, at, None] - xyz[:, col]) ** 2).sum(axis=0)), xyz[:, col])
            out.append(pa.table({"scene_id": np.full(len(at), scene), "pid": pid[at], "done": np.full(len(at), True), **got}))
            out.append(pa.table({"scene_id": np.full(len(left), scene), "pid": pid[left], "done": np.full(len(left), False), **{c: pa.nulls(len(left), out[0].schema.field(c).type) for c in names}}))
        return pa.concat_tables(out) if out else one(part.slice(0, 1).set_column(part.schema.get_field_index("seeks"), "seeks", pa.array([True]))).slice(0, 0)

    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id", "tx", "tz")
    return spread.groupBy("scene_id", "tx", "tz").applyInArrow(one, f"scene_id long, pid long, done boolean, {schema}")


def _search(points: DataFrame, k: int, shape, schema: str) -> DataFrame:
    """Each point's k nearest others in the columns of ``shape``; exact, ties by pid.

    Tiles of the ground plan, sized by each scene's density, are searched with a
    rim; the few points near empty ground go on to tiles four and sixteen times
    as wide, and what is left then meets its whole scene in a join that keeps k
    rows a point before it shuffles.  Each round is written once.
    """
    points, seekers, found = points.select("scene_id", "pid", "x", "y", "z"), None, []
    for widen in (1, 4, 16):
        round_ = keep(_tile_search(points, seekers, k, widen, shape, schema), "neighbours")
        found.append(round_.filter("done").drop("done"))
        seekers = round_.filter("not done").select("scene_id", "pid")
        if seekers.isEmpty():
            break
    else:
        a, b = points.join(seekers, ["scene_id", "pid"], "left_semi").alias("a"), points.alias("b")
        d = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"))
        pairs = a.join(b, (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.pid") != F.col("b.pid"))).select("a.scene_id", "a.pid", *[F.col(f"a.{c}").alias(f"{c}0") for c in "xyz"], F.col("b.pid").alias("other"), d.alias("d"), "b.x", "b.y", "b.z")
        rank = F.row_number().over(Window.partitionBy("scene_id", "pid").orderBy("d", "other"))

        def one(g: pa.Table) -> pa.Table:
            g = g.sort_by("rank")
            own, other, d = np.array([[g[f"{c}0"][0].as_py()] for c in "xyz"]), g["other"].to_numpy()[None], g["d"].to_numpy()[None]
            return pa.table({"scene_id": g["scene_id"][:1], "pid": g["pid"][:1], **shape(own, other, d, np.stack([g[c].to_numpy() for c in "xyz"])[:, None])})

        found.append(pairs.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("scene_id", "pid").applyInArrow(one, f"scene_id long, pid long, {schema}"))
    return reduce(DataFrame.unionByName, found)


def neighbourhoods(points: DataFrame, k: int) -> DataFrame:
    """scene_id, pid, near: each point's k nearest others with distance and place, nearest first."""
    return _search(points, k, _lists, _LISTS)


def nearest_neighbours(points: DataFrame, k: int) -> DataFrame:
    """scene_id, pid, rank (1 is the nearest other point), other, d, of ``neighbourhoods``."""
    df = neighbourhoods(points, k).select("scene_id", "pid", F.posexplode("near").alias("place", "n"))
    return df.select("scene_id", "pid", (F.col("place") + 1).alias("rank"), "n.other", "n.d")


def moments(points: DataFrame, k: int) -> DataFrame:
    """Of each point, its k nearest and itself: n, covariances cxx .. czz, means, h_std, extent, the compactness (height over radius on the ground plan) and the neighbours' nearest, farthest and mean distance."""
    return _search(points, k, _moments, ", ".join(["n long", *[f"{c} double" for c in _MOMENTS]]))


def remove_outliers(points: DataFrame, k: int = 20, spread: float = 2.0) -> DataFrame:
    """Points whose mean distance to their k neighbours is under the scene's mean and ``spread`` deviations."""
    own = moments(points, k).filter("n > 1").select("scene_id", "pid", "mean_d")
    limit = own.groupBy("scene_id").agg((F.avg("mean_d") + spread * F.stddev_pop("mean_d")).alias("limit"))
    return points.join(own.join(limit, "scene_id").filter("mean_d < limit").select("scene_id", "pid", "mean_d"), ["scene_id", "pid"])


def voxels(points: DataFrame, size: float = 0.15, centroid: bool = False) -> DataFrame:
    """One point for each voxel: the one of the smallest pid, or their mean."""
    cell = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    df = points.select("*", *cell)
    keys = ["scene_id", "vx", "vy", "vz"]
    if centroid:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
    first = F.min_by(F.struct("pid", "x", "y", "z"), "pid")
    return df.groupBy(*keys).agg(first.alias("first"), F.count("*").alias("n")).select(*keys, "n", "first.pid", "first.x", "first.y", "first.z")


def height_grid(points: DataFrame, cell: float = 0.5) -> DataFrame:
    """scene_id, row, col, h: the highest point of each cell, counted from the scene's corner."""
    corner = points.groupBy("scene_id").agg(F.min("x").alias("x0"), F.min("z").alias("z0"))
    at = lambda c: ((F.col(c) - F.col(f"{c}0")) / cell).cast("int")
    return points.join(corner, "scene_id").groupBy("scene_id", at("z").alias("row"), at("x").alias("col")).agg(F.max("y").alias("h"))


def full_grid(grid: DataFrame, points: DataFrame | None = None, cell: float = 0.5) -> DataFrame:
    """All cells of each scene's rectangle, h null where empty.

    With ``points`` the rectangle is the cloud's extent in whole cells and one
    more row and column; without, it ends at the last filled ones.
    """
    if points is None:
        size = grid.groupBy("scene_id").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    else:
        span = lambda a: F.ceil((F.max(a) - F.min(a)) / cell).cast("int")
        size = points.groupBy("scene_id").agg(span("z").alias("rows"), span("x").alias("cols"))
    cells = size.withColumn("row", F.explode(F.sequence(F.lit(0), "rows"))).withColumn("col", F.explode(F.sequence(F.lit(0), "cols"))).select("scene_id", "row", "col")
    return cells.join(grid, ["scene_id", "row", "col"], "left")


def fill_grid(cells: DataFrame) -> DataFrame:
    """Empty cells (h null) take the height of the nearest filled cell, however far (ties: smaller row, then column).

    The distance is separable: each cell first looks along its row for the
    nearest filled cell to the left and right, then empty cells compare the
    finds of all rows in their column.
    """
    c, own = F.col, Window.partitionBy("scene_id", "row")
    here = F.when(c("h").isNotNull(), F.struct("col", "h"))
    df = cells.withColumns({"l": F.last(here, True).over(own.orderBy("col")), "r": F.first(here, True).over(own.orderBy("col").rowsBetween(0, Window.unboundedFollowing))})
    left, right = c("col") - c("l.col"), c("r.col") - c("col")
    near = F.when(c("r").isNull() | (left <= right), c("l")).otherwise(c("r"))
    finds = df.withColumn("n", near).filter("n is not null").select("scene_id", "col", c("row").alias("r"), (c("n.col") - c("col")).alias("dc"), c("n.col").alias("c"), c("n.h").alias("nh"))
    offer = cells.filter("h is null").select("scene_id", "row", "col").join(finds, ["scene_id", "col"])
    d2 = (c("r") - c("row")) * (c("r") - c("row")) + c("dc") * c("dc")
    best = offer.groupBy("scene_id", "row", "col").agg(F.min(F.struct(d2.alias("d2"), "r", "c", "nh")).alias("o"))
    return cells.join(best, ["scene_id", "row", "col"], "left").select("scene_id", "row", "col", F.coalesce("h", "o.nh").alias("h"), c("h").isNull().alias("filled"))


#: Tiles of a search by radius are as many radii wide; the first is centred, so a scene of that size is one tile.
TILE, BATCH = 64, 1 << 20


def _pairs_within(axes: list[np.ndarray], r: float):
    """Yields (i, j, d) of all pairs of places within r of each other, each once, in bounded pieces: cells as wide as r, a cell against itself and half its neighbours."""
    wide = r * (1 + 1e-9)
    cx, cz = (np.floor((c - c.min()) / wide).astype(np.int64) for c in (axes[0], axes[-1]))
    row = cx.max() + 3
    order = np.argsort(cz * row + cx, kind="stable")
    key, axes = (cz * row + cx)[order], [c[order] for c in axes]
    for first, last in ((np.arange(1, len(key) + 1), np.searchsorted(key, key + 1, "right")), (np.searchsorted(key, key + row - 1), np.searchsorted(key, key + row + 1, "right"))):
        upto, a = np.cumsum(last - first), 0
        while a < len(key):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BATCH, "right")))
            n = (last - first)[a:b]
            i = np.repeat(np.arange(a, b), n)
            j = np.arange(len(i)) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
            d = np.sqrt(sum((c[i] - c[j]) * (c[i] - c[j]) for c in axes))
            hit = d <= r
            yield order[i[hit]], order[j[hit]], d[hit]
            a = b


def _tiles(df: DataFrame, radius: Column) -> DataFrame:
    """Rows with tx, tz of each tile that they lie in or within the radius ``r`` of, and ``home``, true in their own tile."""
    df = df.withColumn("r", radius)
    tile = lambda a, off: F.floor(F.col(a) / (TILE * F.col("r")) + num(0.5 + off * (1 + 1e-9) / TILE)).cast("long")
    df = df.withColumns({"hx": tile("x", 0), "hz": tile("z", 0), "tx": F.explode(F.sequence(tile("x", -1), tile("x", 1)))}).withColumn("tz", F.explode(F.sequence(tile("z", -1), tile("z", 1))))
    return df.withColumn("home", (F.col("tx") == F.col("hx")) & (F.col("tz") == F.col("hz"))).drop("hx", "hz")


def near_pairs(seekers: DataFrame, points: DataFrame, radius: float | str, flat: bool = False, once: bool = False) -> DataFrame:
    """scene_id, a, b, d for each seeker a and point b within the radius; ``once`` keeps a < b.

    The radius is a number, or a column of the seekers and the points that is one
    value a scene.  A point goes to its tile of the ground plan, and near a side
    to the tile behind; pairs are found there, by their first point's tile.
    ``flat`` measures on the ground plan.
    """
    axes = "xz" if flat else "xyz"
    extra = [radius] if isinstance(radius, str) else []
    side = lambda df, s, p: df.select("scene_id", "pid", *axes, *extra, F.lit(s).alias("s"), F.lit(p).alias("p"))
    both = side(points, True, True) if seekers is points else side(seekers, True, False).unionByName(side(points, False, True))
    df = _tiles(both, F.col(radius) if extra else num(radius)).filter("r > 0").drop(*extra)

    def one(part: pa.Table) -> pa.Table:
        pid, home, s, p = (part[c].to_numpy() for c in ("pid", "home", "s", "p"))
        scene, found = part["scene_id"][0].as_py(), []

        def put(i, j, d):
            keep_ = home[i] & s[i] & p[j] & ((pid[i] < pid[j]) | (not once))
            found.append((pid[i[keep_]], pid[j[keep_]], d[keep_]))

        own = np.arange(len(pid))
        put(own, own, np.zeros(len(pid)))
        for i, j, d in _pairs_within([part[c].to_numpy() for c in axes], part["r"][0].as_py()):
            put(i, j, d)
            put(j, i, d)
        a, b, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"scene_id": np.full(len(a), scene), "a": a, "b": b, "d": d})

    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id", "tx", "tz")
    return spread.groupBy("scene_id", "tx", "tz").applyInArrow(one, "scene_id long, a long, b long, d double")


def near_counts(points: DataFrame, radius: float | str, flat: bool = False) -> DataFrame:
    """scene_id, pid, near: how many points lie within the radius, itself included; counted in the tiles of ``near_pairs``, no pair is listed."""
    axes = "xz" if flat else "xyz"
    extra = [radius] if isinstance(radius, str) else []
    df = _tiles(points.select("scene_id", "pid", *axes, *extra), F.col(radius) if extra else num(radius)).filter("r > 0").drop(*extra)

    def one(part: pa.Table) -> pa.Table:
        home = part["home"].to_numpy()
        near = np.ones(len(home), np.int64)
        for i, j, _ in _pairs_within([part[c].to_numpy() for c in axes], part["r"][0].as_py()):
            near += np.bincount(i, minlength=len(near)) + np.bincount(j, minlength=len(near))
        return pa.table({"scene_id": part["scene_id"].to_numpy()[home], "pid": part["pid"].to_numpy()[home], "near": near[home]})

    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id", "tx", "tz")
    return spread.groupBy("scene_id", "tx", "tz").applyInArrow(one, "scene_id long, pid long, near long")


def near_links(points: DataFrame, radius: float | str, name: str) -> DataFrame:
    """scene_id, p, q (p < q): the values of the column ``name`` that points within the radius on the ground plan link, once for each tile at most."""
    extra = [radius] if isinstance(radius, str) else []
    df = _tiles(points.select("scene_id", F.col(name).alias("name"), "x", "z", *extra), F.col(radius) if extra else num(radius)).filter("r > 0").drop(*extra)

    def one(part: pa.Table) -> pa.Table:
        named, code = np.unique(part["name"].to_numpy(), return_inverse=True)
        home, links = part["home"].to_numpy(), np.empty(0, np.int64)
        for i, j, _ in _pairs_within([part[c].to_numpy() for c in "xz"], part["r"][0].as_py()):
            use = (home[i] | home[j]) & (code[i] != code[j])
            i, j = code[i[use]], code[j[use]]
            links = np.union1d(links, np.minimum(i, j) * len(named) + np.maximum(i, j))
        return pa.table({"scene_id": np.full(len(links), part["scene_id"][0].as_py()), "p": named[links // len(named)], "q": named[links % len(named)]})

    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id", "tx", "tz")
    return spread.groupBy("scene_id", "tx", "tz").applyInArrow(one, "scene_id long, p long, q long")


def radius_pairs(points: DataFrame, radius: float | str, flat: bool = False) -> DataFrame:
    """scene_id, a, b, d for points a < b within the radius."""
    return near_pairs(points, points, radius, flat, once=True)


def patches(points: DataFrame, radius: float | str) -> DataFrame:
    """scene_id, pid, patch: points that hang together on the ground plan by steps within the radius, named by their smallest pid.

    All points of a cell whose diagonal is the radius hang together, so only
    cells are joined up: as many as the ground plan has, whatever the density.
    """
    r = num(radius) if not isinstance(radius, str) else F.col(radius)
    side = r / num(1.4142135624)
    df = points.withColumn("cell", F.struct(F.floor(F.col("x") / side).alias("x"), F.floor(F.col("z") / side).alias("z")))
    names = df.groupBy("scene_id", "cell").agg(F.min("pid").alias("first"))
    named = keep(df.join(names, ["scene_id", "cell"]).drop("cell"), "cells")
    of = named.select("scene_id", "pid", "first")
    edges = near_links(named, radius, "first").distinct()
    label = components(names.select("scene_id", F.col("first").alias("node")), edges)
    return of.join(label.withColumnRenamed("node", "first"), ["scene_id", "first"]).select("scene_id", "pid", F.col("label").alias("patch"))


def adaptive_thresholds(points: DataFrame, features: DataFrame) -> DataFrame:
    """Limits that follow each scene: distance, roughness, curvature, ground height, compactness.

    ``features``: scene_id, pid, curvature, compactness, nearest (distance of the nearest other point).
    """
    near = features.groupBy("scene_id").agg(F.percentile("nearest", 0.5).alias("nn"))
    heights = points.groupBy("scene_id").agg(F.count("*").alias("n"), F.percentile("y", 0.1).alias("h10"), F.percentile("y", 0.9).alias("h90"))
    own = Window.partitionBy("scene_id")
    place = lambda c: F.row_number().over(own.orderBy(c, "pid"))
    ranked = features.filter("curvature > 0").select("scene_id", "curvature", place("curvature").alias("rank"), F.count("*").over(own).alias("all"))
    calm = ranked.filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("all") / 5))).groupBy("scene_id").agg(F.percentile("curvature", 0.5).alias("calm"))
    # The first of the upper fifth: rank n_roof + 1 of those above zero, the last where there are no more.
    tall = features.filter("compactness > 0").select("scene_id", "compactness", place("compactness").alias("rank"), F.count("*").over(own).alias("all"))
    roof = F.greatest(F.lit(1), F.floor(F.col("all") * num(0.8)))
    tall = tall.filter((F.col("all") > 10) & (F.col("rank") == F.least(roof + 1, F.col("all")))).select("scene_id", F.greatest(num(2), 2 * F.col("compactness")).alias("compact"))
    df = heights.join(near, "scene_id", "left").join(calm, "scene_id", "left").join(tall, "scene_id", "left")
    df = df.withColumn("nn", F.when(F.col("n") > 2, F.col("nn")).otherwise(num(0.15))).withColumn("distance", clip(2 * F.col("nn"), 0.05, 0.30))
    span = F.when(F.col("n") > 10, F.col("h90") - F.col("h10")).otherwise(num(3))
    return df.select("scene_id", "nn", "distance", F.greatest(num(0.08), 3 * F.col("distance")).alias("roughness"), F.greatest(num(0.05), 5 * F.coalesce("calm", num(0.01))).alias("curvature"), F.greatest(num(0.3), F.col("h10") + num(0.15) * span).alias("ground"), F.coalesce("compact", num(2)).alias("compactness"))


def eigen3(df: DataFrame) -> DataFrame:
    """With e1 <= e2 <= e3, the eigenvalues of the symmetric matrix cxx .. czz, in closed form."""
    c = {k: F.col(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    df = df.withColumn("_q", (c["xx"] + c["yy"] + c["zz"]) / 3)
    q = F.col("_q")
    p2 = (c["xx"] - q) ** 2 + (c["yy"] - q) ** 2 + (c["zz"] - q) ** 2 + 2 * (c["xy"] ** 2 + c["xz"] ** 2 + c["yz"] ** 2)
    df = df.withColumn("_p", F.sqrt(p2 / 6))
    a, b, d = c["xx"] - q, c["yy"] - q, c["zz"] - q
    det = a * (b * d - c["yz"] ** 2) - c["xy"] * (c["xy"] * d - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - b * c["xz"])
    flat = F.col("_p") <= 0
    df = df.withColumn("_t", F.acos(clip(det / (2 * F.when(flat, num(1)).otherwise(F.pow(F.col("_p"), num(3)))), -1, 1)) / 3)
    top, low = q + 2 * F.col("_p") * F.cos("_t"), q + 2 * F.col("_p") * F.cos(F.col("_t") + num(2.0943951023931953))
    return df.withColumns({"e3": top, "e1": low}).withColumn("e2", 3 * q - F.col("e1") - F.col("e3")).drop("_q", "_p", "_t")


def normals(df: DataFrame) -> DataFrame:
    """With nx, ny, nz: the unit eigenvector of e1, pointing up, as the longest cross product of two rows of (C - e1)."""
    e = F.col("e1")
    rows = [(F.col("cxx") - e, F.col("cxy"), F.col("cxz")), (F.col("cxy"), F.col("cyy") - e, F.col("cyz")), (F.col("cxz"), F.col("cyz"), F.col("czz") - e)]

    def cross(u, v):
        return F.struct((u[1] * v[2] - u[2] * v[1]).alias("x"), (u[2] * v[0] - u[0] * v[2]).alias("y"), (u[0] * v[1] - u[1] * v[0]).alias("z"))

    sides = F.array(*[cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))])
    sized = F.transform(sides, lambda s: F.struct((s["x"] ** 2 + s["y"] ** 2 + s["z"] ** 2).alias("w"), s.alias("s")))
    df = df.withColumn("_b", F.element_at(F.array_sort(sized), -1))
    up = F.when(F.col("_b.s.y") < 0, num(-1)).otherwise(num(1)) / F.when(F.col("_b.w") > 0, F.sqrt("_b.w")).otherwise(num(1))
    dull = F.col("_b.w") <= 0
    return df.withColumns({"nx": F.when(dull, num(0)).otherwise(F.col("_b.s.x") * up), "ny": F.when(dull, num(1)).otherwise(F.col("_b.s.y") * up), "nz": F.when(dull, num(0)).otherwise(F.col("_b.s.z") * up)}).drop("_b")


def features(points: DataFrame, k: int = 20) -> DataFrame:
    """Normal, curvature, height deviation, compactness of each point over its k nearest, itself among them; under three points it counts as level."""
    df = normals(eigen3(moments(points, k - 1)))
    few, sums = F.col("n") < 3, F.col("e1") + F.col("e2") + F.col("e3")
    df = df.withColumn("curvature", F.when(sums > 1e-12, F.greatest(num(0), F.col("e1")) / F.when(sums > 1e-12, sums).otherwise(num(1))).otherwise(num(0)))
    level = {"nx": 0, "ny": 1, "nz": 0, "curvature": 0, "h_std": 0, "compactness": 0}
    return df.withColumns({c: F.when(few, num(v)).otherwise(F.col(c)) for c, v in level.items()})
