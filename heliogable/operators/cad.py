"""Hip roofs over four-cornered faces: skeleton, sections under deletions, lines, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogable.functions.columns import num, shoelace

FEET, SQUARE_FEET = 3.28084, 10.7639
LIFT = 0.12
# The points of the compass.
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def compass_name(azimuth: Column) -> Column:
    return F.get(F.array(*map(F.lit, COMPASS)), (F.floor(F.pmod(azimuth, num(360)) / 45 + 0.5) % 8).cast("int"))


def hip_geometry(faces: DataFrame) -> DataFrame:
    """Faces (xs, zs of four corners, pitch) with a .. d (corners from a long side on), ridge ends r0, r1, side middles m0, m1, mf, mb, peak p, inset and ridge_y."""
    side = lambda i, j: F.sqrt((F.get("xs", F.lit(j)) - F.get("xs", F.lit(i))) ** 2 + (F.get("zs", F.lit(j)) - F.get("zs", F.lit(i))) ** 2)
    first, second = side(0, 1), side(1, 2)
    df = faces.withColumns({"long": F.greatest(first, second), "short": F.least(first, second), "turn": F.when(first >= second, 0).otherwise(1)})
    corner = lambda k, axis: F.get(axis, (F.col("turn") + k) % 4)
    point = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    df = df.withColumns({name: point(corner(k, "xs"), corner(k, "zs")) for k, name in enumerate("abcd")})
    c = F.col
    mid = lambda u, v: point((c(f"{u}.x") + c(f"{v}.x")) / 2, (c(f"{u}.z") + c(f"{v}.z")) / 2)
    df = df.withColumns({"m0": mid("a", "d"), "m1": mid("b", "c"), "mf": mid("a", "b"), "mb": mid("d", "c"), "inset": c("short") / 2})
    along = {k: (c(f"b.{k}") - c(f"a.{k}")) / F.when(c("long") > 0, c("long")).otherwise(num(1)) * c("inset") for k in "xz"}
    df = df.withColumns({"r0": point(c("m0.x") + along["x"], c("m0.z") + along["z"]), "r1": point(c("m1.x") - along["x"], c("m1.z") - along["z"])})
    return df.withColumns({"p": mid("r0", "r1"), "ridge_y": c("inset") * F.tan(F.radians("pitch")) + num(LIFT)}).drop("turn")


def sections(hips: DataFrame) -> DataFrame:
    """(keys, section 0..3, corners in order as names) of hips with ``gone``, four flags; a deleted section has no row.

    Corners are names of hip_geometry's points; rX stands for a ridge end that a
    deleted end triangle has pushed out to its side.
    """
    g = lambda k: F.get("gone", F.lit(k))
    e0, e1 = F.when(g(0), F.lit("m0")).otherwise(F.lit("r0")), F.when(g(1), F.lit("m1")).otherwise(F.lit("r1"))
    names = lambda *x: F.array(*[F.lit(n) if isinstance(n, str) else n for n in x])
    nothing = F.lit(None).cast("array<string>")
    neither = F.array(names("a", "r0", "d"), names("b", "c", "r1"), names("a", "b", e1, e0), names("d", e0, e1, "c"))
    both = F.array(names("a", "mf", "mb", "d"), names("mf", "b", "c", "mb"), nothing, nothing)
    front = F.array(names("a", "mf", "p", "d"), names("mf", "b", "c", "p"), nothing, names("d", "p", "c"))
    back = F.array(names("a", "p", "mb", "d"), names("b", "c", "mb", "p"), names("a", "b", "p"), nothing)
    made = F.when(~g(2) & ~g(3), neither).when(g(2) & g(3), both).when(g(2), front).otherwise(back)
    df = hips.select("face_id", "gone", F.posexplode(made).alias("section", "corners"))
    return df.filter(F.col("corners").isNotNull() & ~F.get("gone", F.col("section"))).select("face_id", "section", "corners")


def section_areas(hips: DataFrame) -> DataFrame:
    """Plan area of each section."""
    df = sections(hips).join(hips.select("face_id", *[F.struct(F.lit(n).alias("n"), F.col(f"{n}.x").alias("x"), F.col(f"{n}.z").alias("z")).alias(f"_{n}") for n in ("a", "b", "c", "d", "r0", "r1", "m0", "m1", "mf", "mb", "p")]), "face_id")
    all_points = F.array(*[F.col(f"_{n}") for n in ("a", "b", "c", "d", "r0", "r1", "m0", "m1", "mf", "mb", "p")])
    at = lambda axis: F.transform("corners", lambda n: F.get(F.filter(all_points, lambda q: q["n"] == n), F.lit(0))[axis])
    return df.select("face_id", "section", F.array_join("corners", "-").alias("outline"), shoelace(at("x"), at("z")).alias("area"))


def hip_lines(hips: DataFrame) -> DataFrame:
    """(face_id, line): the lines that are drawn for each pattern of deletions, as pairs of point names."""
    g = lambda k: F.get("gone", F.lit(k))
    e0, e1 = F.when(g(0), F.lit("m0")).otherwise(F.lit("r0")), F.when(g(1), F.lit("m1")).otherwise(F.lit("r1"))
    neither, both, front, back = ~g(2) & ~g(3), g(2) & g(3), g(2) & ~g(3), ~g(2) & g(3)
    lines = [
        (neither & ~g(0), "a-r0"), (neither & ~g(0), "d-r0"), (neither & ~g(1), "b-r1"), (neither & ~g(1), "c-r1"), (neither, F.concat_ws("-", e0, e1)), (both & (~g(0) | ~g(1)), "mf-mb"),
        (front & ~g(0) & ~g(1), "mf-p"), (front & ~g(0), "d-p"), (front & ~g(1), "c-p"), (back & ~g(0) & ~g(1), "mb-p"), (back & ~g(0), "a-p"), (back & ~g(1), "b-p"),
    ]
    made = F.filter(F.array(*[F.when(cond, F.lit(n) if isinstance(n, str) else n) for cond, n in lines]), lambda n: n.isNotNull())
    return hips.select("face_id", F.explode(made).alias("line"))


def properties(faces: DataFrame) -> DataFrame:
    """What the panel shows of a face: compass point, height and sides in feet, slope in twelfths, area in square feet."""
    n = F.size("xs")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(F.sqrt((F.get("xs", (i + 1) % n) - F.get("xs", i)) ** 2 + (F.get("zs", (i + 1) % n) - F.get("zs", i)) ** 2) * FEET, 1))
    return faces.select("face_id", compass_name(F.col("azimuth")).alias("direction"), F.round(F.col("height") * FEET, 1).alias("height_ft"), F.round(12 * F.tan(F.radians("pitch")), 1).alias("slope_12"), F.round(shoelace(F.col("xs"), F.col("zs")) * SQUARE_FEET, 0).alias("area_ft2"), sides.alias("sides_ft"))


def history(actions: DataFrame, depth: int = 50) -> DataFrame:
    """Undo stacks from an ordered log (doc, seq, action in do / undo / redo, state): how many steps can be undone and redone, and the state in view.

    A log is folded in order inside one array per document; the stack keeps its
    last ``depth`` steps.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "action", "state")))
    start = F.struct(F.array().cast("array<long>").alias("undo"), F.lit(None).cast("long").alias("now"), F.array().cast("array<long>").alias("redo"))

    def step(s, e):
        grown = F.when(s["now"].isNull(), s["undo"]).otherwise(F.concat(s["undo"], F.array(s["now"])))
        done = F.struct(F.slice(grown, F.greatest(F.lit(1), F.size(grown) - depth + 1), depth).alias("undo"), e["state"].alias("now"), F.array().cast("array<long>").alias("redo"))
        undone = F.struct(F.slice(s["undo"], 1, F.greatest(F.lit(0), F.size(s["undo"]) - 1)).alias("undo"), F.element_at(s["undo"], -1).alias("now"), F.concat(s["redo"], F.array(s["now"])).alias("redo"))
        redone = F.struct(F.concat(s["undo"], F.array(s["now"])).alias("undo"), F.element_at(s["redo"], -1).alias("now"), F.slice(s["redo"], 1, F.greatest(F.lit(0), F.size(s["redo"]) - 1)).alias("redo"))
        return F.when(e["action"] == "do", done).when((e["action"] == "undo") & (F.size(s["undo"]) > 0), undone).when((e["action"] == "redo") & (F.size(s["redo"]) > 0), redone).otherwise(s)

    folded = actions.groupBy("doc").agg(steps.alias("log")).select("doc", F.aggregate("log", start, step).alias("s"))
    return folded.select("doc", F.size("s.undo").cast("long").alias("can_undo"), F.size("s.redo").cast("long").alias("can_redo"), F.col("s.now").alias("state"))
