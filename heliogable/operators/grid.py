"""Stencils over height grids: gradients, roughness, variance, drop-offs at the edge of faces.

A grid is a table (scene_id, row, col, h) with a row for each cell of the scene's
rectangle; what a cell needs of its neighbours comes by windows along rows and
columns or by a patch that each cell is dealt to, so no scene is held in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogable.functions.columns import num
from heliogable.operators.points import eigen3

_KEYS = ["scene_id", "row", "col"]


def gradients(grid: DataFrame) -> DataFrame:
    """With dx and dz: half the difference of the neighbours along columns and rows, at the rim the whole difference to the one neighbour; null without any."""
    out = grid
    for name, along, across in (("dx", "col", "row"), ("dz", "row", "col")):
        line = Window.partitionBy("scene_id", across).orderBy(along)
        before, after = F.lag("h").over(line), F.lead("h").over(line)
        out = out.withColumn(name, F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(F.coalesce(after - F.col("h"), F.col("h") - before)))
    return out


def patches_of(grid: DataFrame, half: int) -> DataFrame:
    """(scene_id, row, col, r, c, h): each cell with the cells of the square patch around it, as far as the grid goes."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    dealt = grid.filter("h is not null").withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    dealt = dealt.select("scene_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col("row").alias("r"), F.col("col").alias("c"), "h")
    return dealt.join(grid.select(*_KEYS), _KEYS, "left_semi")


def local_variance(grid: DataFrame) -> DataFrame:
    """(scene_id, row, col, variance) of heights in each cell's 3 x 3 patch; 0 with under three heights."""
    own = patches_of(grid, 1).groupBy(*_KEYS).agg(F.count("*").alias("n"), F.var_pop("h").alias("variance"))
    return own.select(*_KEYS, F.when(F.col("n") < 3, num(0)).otherwise(F.col("variance")).alias("variance"))


def roughness(grid: DataFrame, size: int = 5) -> DataFrame:
    """(scene_id, row, col, roughness): root mean square distance of each cell's patch from its best plane, in cells; patches under six cells have none."""
    axes = {"x": F.col("c").cast("double"), "y": F.col("h"), "z": F.col("r").cast("double")}
    df = patches_of(grid, size // 2).select(*_KEYS, *[v.alias(k) for k, v in axes.items()])
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    df = df.groupBy(*_KEYS).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs]).filter("n >= 6")
    return eigen3(df).select(*_KEYS, F.sqrt(F.greatest(num(0), F.col("e1"))).alias("roughness"))


def smooth_cells(grid: DataFrame, most: float, size: int = 5, lowest: float = 0.5) -> DataFrame:
    """Cells at ``lowest`` or higher, with a whole patch inside the grid, that are no rougher than ``most``."""
    half = size // 2
    limit = grid.groupBy("scene_id").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    inner = grid.join(limit, "scene_id").filter(F.col("row").between(half, F.col("rows") - half) & F.col("col").between(half, F.col("cols") - half) & (F.col("h") >= lowest)).select(*_KEYS)
    return inner.join(roughness(grid, size).filter(F.round("roughness", 9) <= most).select(*_KEYS), _KEYS, "left_semi")


def dropoffs(grid: DataFrame, face: DataFrame, ground: float = 1.5, least: float = 0.5) -> DataFrame:
    """(scene_id, row, col, kind) at the edge of a face (cells scene_id, row, col).

    A neighbour outside that lies more than ``least`` lower is met once, from the
    first face cell in reading order: under ``ground`` the face cell is a ground
    edge, else the neighbour is a roof edge.  A face cell is a weak edge once for
    each neighbour that lies within ``least`` of it.
    """
    c, inside = F.col, face.select(*_KEYS).distinct()
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(n).alias("n")) for n, (r, k) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))])
    near = grid.join(inside, _KEYS, "left_semi").withColumn("s", F.explode(steps)).select("scene_id", c("row").alias("fr"), c("col").alias("fc"), c("h").alias("fh"), c("s.n").alias("n"), (c("row") + c("s.r")).alias("row"), (c("col") + c("s.k")).alias("col"))
    near = near.join(grid, _KEYS).join(inside, _KEYS, "left_anti").withColumn("drop", c("fh") - c("h"))
    met = near.filter(c("drop") > least).groupBy(*_KEYS).agg(F.min(F.struct("fr", "fc", "n", "h")).alias("m"))
    low = c("m.h") < ground
    strong = met.select("scene_id", F.when(low, c("m.fr")).otherwise(c("row")).alias("row"), F.when(low, c("m.fc")).otherwise(c("col")).alias("col"), F.when(low, F.lit("ground")).otherwise(F.lit("roof")).alias("kind"))
    weak = near.filter(F.abs("drop") <= least).select("scene_id", c("fr").alias("row"), c("fc").alias("col"), F.lit("weak").alias("kind"))
    return strong.unionByName(weak)
