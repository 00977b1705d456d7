"""Data behind plots: hexagonal places, colours, points, scaled values, polygons."""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lymphframe.operators.grouping import fresh, numbered_within


def hex_place(k: int) -> tuple[float, float]:
    """Centre of the k-th cell (from 0) on a hexagonal spiral of unit spacing."""
    if k == 0:
        return 0.0, 0.0
    ring = math.ceil((math.sqrt(12 * k + 9) - 3) / 6 - 1e-12)
    side, step = divmod(k - 3 * ring * (ring - 1) - 1, ring)
    corner = [(math.cos(math.pi / 3 * s), math.sin(math.pi / 3 * s)) for s in range(7)]
    (x, y), (u, v) = corner[side], corner[side + 1]
    t = step / ring
    return ring * (x + (u - x) * t), ring * (y + (v - y) * t)


def hex_columns(k: Column) -> tuple[Column, Column]:
    """hex_place() as expressions of a column of places."""
    ring = F.ceil((F.sqrt(12 * k + 9) - 3) / 6 - 1e-12)
    past = k - 3 * ring * (ring - 1) - 1
    side, t = F.floor(past / ring).cast("int"), (past % ring).cast("double") / ring

    def one(f) -> Column:
        corner = F.array(*(F.lit(f(math.pi / 3 * s)) for s in range(7)))
        return F.when(k == 0, 0.0).otherwise(ring * (F.get(corner, side) + (F.get(corner, side + 1) - F.get(corner, side)) * t))

    return one(math.cos), one(math.sin)


def scaled(x: Column, low: Column, high: Column) -> Column:
    """x clamped to low..high, as an index 0..255 of a palette."""
    return F.floor(F.try_divide(F.least(F.greatest(x, low), high) - low, high - low) * 255 + 0.5)


def inside(polygon: list[tuple[float, float]], x: float, y: float) -> bool:
    """Whether a point lies in a polygon, by the crossings of a ray."""
    out = False
    for (a, b), (c, d) in zip(polygon, polygon[1:] + polygon[:1]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            out = not out
    return out


def inside_columns(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """inside() as an expression of two columns."""
    out = F.lit(0)
    for (a, b), (c, d) in zip(polygon, polygon[1:] + polygon[:1]):
        if b != d:
            out = out + ((F.lit(b) > y) != (F.lit(d) > y)).cast("int") * (x < (c - a) * (y - b) / (d - b) + a).cast("int")
    return out % 2 == 1


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round values between low and high, at most so many."""
    if high <= low:
        return [low]
    step = 10 ** math.floor(math.log10((high - low) / most))
    while (high - low) / step + 1 > most:
        step = {1: 2, 2: 5, 5: 10}[round(step / 10 ** math.floor(math.log10(step) + 1e-9))] * 10 ** math.floor(math.log10(step) + 1e-9)
    first = math.ceil(low / step - 1e-9)
    return [round(k * step, 12) for k in range(first, math.floor(high / step + 1e-9) + 1)]


def pack_circles(radii: list[float], seed: int = 0, blocked: list[tuple[float, float]] | None = None, quarter: bool = False) -> list[tuple[float, float]]:
    """Centres of circles that don't overlap, largest first, each at the least radius found by random directions.

    blocked: a polygon that no centre may lie in; quarter: only places with x, y >= 0.
    Placed circles are held by the sectors they can block, so a direction reads one sector.
    """
    import random

    rng = random.Random(seed)
    order = sorted(range(len(radii)), key=lambda i: (-radii[i], i))
    n, sectors = len(radii), max(16, min(4096, len(radii)))
    x, y, q = np.zeros(n), np.zeros(n), np.zeros(n)
    held: list[list[int]] = [[] for _ in range(sectors)]
    far = 0.0
    out = [(0.0, 0.0)] * n
    for count, i in enumerate(order):
        r, best = radii[i], None
        turns = [rng.random() * (math.pi / 2 if quarter else 2 * math.pi) for _ in range(40)]
        near = [held[min(sectors - 1, int(t / (2 * math.pi) * sectors))] for t in turns]
        k = np.fromiter(chain.from_iterable(near), np.int64)
        way = np.repeat(np.arange(40), [len(c) for c in near])
        u, v = np.array([math.cos(t) for t in turns]), np.array([math.sin(t) for t in turns])
        # along a direction a placed circle blocks an interval of distances
        off, reach = np.abs(x[k] * v[way] - y[k] * u[way]), q[k] + r
        hit = off < reach
        k, way, off, reach = k[hit], way[hit], off[hit], reach[hit]
        along, half = x[k] * u[way] + y[k] * v[way], np.sqrt(reach * reach - off * off)
        low, high = along - half, along + half
        by = np.lexsort((low, way))
        low, high, edge = low[by], high[by], np.searchsorted(way[by], np.arange(41))
        for t in range(40):
            a, b = low[edge[t] : edge[t + 1]], high[edge[t] : edge[t + 1]]
            at = r if quarter else 0.0
            if len(a):
                upto = np.maximum(np.maximum.accumulate(b), at)
                free = np.flatnonzero(np.append(a, np.inf) >= np.append(at, upto))[0]
                at = float(upto[free - 1]) if free else at
            while blocked and inside(blocked, at * u[t], at * v[t]):
                at += r
            if ((a < at) & (at < b)).any():
                continue
            if best is None or at < best[0]:
                best = (at, float(at * u[t]), float(at * v[t]))
        if best is None:  # far out nothing is in the way
            best = (far + r, far + r, 0.0)
        out[i] = best[1:]
        x[count], y[count], q[count] = *best[1:], r
        d = math.hypot(*best[1:])
        far = max(far, d + r)
        # circles to come are no larger, so this one blocks directions within asin(2 r / d) of its own
        if d <= 2 * r:
            for s in held:
                s.append(count)
        else:
            turn, wide = math.atan2(best[2], best[1]), math.asin(2 * r / d)
            first, last = (math.floor((turn + w) / (2 * math.pi) * sectors + e) for w, e in ((-wide, -1e-6), (wide, 1e-6)))
            for s in range(first, min(last, first + sectors - 1) + 1):
                held[s % sectors].append(count)
    return out


#: Coefficients of the turbo colour map's red, green and blue, from the constant on.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def turbo(k: int) -> str:
    """Colour k of 0..255 on the turbo colour map, as #rrggbb, by its published polynomials of fifth degree."""
    t = min(255, max(0, k)) / 255
    part = lambda c: min(255, max(0, math.floor(255 * sum(a * t**i for i, a in enumerate(c)) + 0.5)))
    return "#" + "".join(f"{part(c):02x}" for c in TURBO)


def palette_distance(a: str, b: str) -> float:
    """Distance of two #rrggbb colours in CIELAB."""

    def lab(c: str) -> tuple[float, float, float]:
        v = [int(c[k : k + 2], 16) / 255 for k in (1, 3, 5)]
        v = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in v]
        # fixed values: sRGB to XYZ under D65
        xyz = [sum(m * x for m, x in zip(row, v)) / w for row, w in zip(((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505)), (0.95047, 1.0, 1.08883))]
        f = [x ** (1 / 3) if x > 216 / 24389 else (24389 / 27 * x + 16) / 116 for x in xyz]
        return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])

    return math.dist(lab(a), lab(b))


def svg(circles: list[tuple[float, float, float, str]], size: int = 400) -> str:
    """An SVG of filled circles (x, y, radius, colour), scaled to fit."""
    far = max((max(abs(x), abs(y)) + r for x, y, r, _ in circles), default=1.0)
    k = size / 2 / far
    body = "".join(f'<circle cx="{size / 2 + x * k:.2f}" cy="{size / 2 - y * k:.2f}" r="{r * k:.2f}" fill="{c}"/>' for x, y, r, c in circles)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{body}</svg>'


def category_shades(cells: DataFrame, category: str, most: int) -> DataFrame:
    """cells with `shade`: the place from 0 of their category by frequency, ties by name; `most` for those beyond the first `most`."""
    top = cells.groupBy(category).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), category).limit(most)  # a top-k list
    ranked = top.select(F.col(category).alias("__c"), (F.row_number().over(Window.orderBy(F.desc("__n"), category)) - 1).cast("long").alias("shade"))
    return cells.join(F.broadcast(ranked), F.col(category).eqNullSafe(F.col("__c")), "left").drop("__c").withColumn("shade", F.coalesce("shade", F.lit(most).cast("long")))


def relocated(clusters: DataFrame, part: str | None = None) -> DataFrame:
    """clusters (id, size, colour, x, y, ...) with like colours brought together: places of one size are dealt out again by colour, in order of their angle.

    A cluster of several colours has a null colour and stays. Places go to clusters of the same size and,
    if given, the same `part` only, so circles fit as before. Clusters are ordered by colour and id,
    places by angle, rounded to 1e-9, and id; both are numbered by ranges, so a size that most clusters
    have, that of single cells, is no single task's work.
    """
    key, angle, k = fresh(clusters.columns, "key", "angle", "k")
    one = clusters.where("colour IS NOT NULL").withColumn(key, F.concat_ws("|", F.col("size").cast("string"), *([F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit("-"))] if part else [])))
    one = one.withColumn(angle, F.floor(F.atan2("y", "x") * 1e9 + 0.5))
    to = numbered_within(one.select(key, angle, "id", "x", "y"), key, [angle, "id"], k).select(F.col(key).alias("to_key"), F.col(k).alias("to_k"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    moved = numbered_within(one, key, ["colour", "id"], k).join(to, (F.col(key) == F.col("to_key")) & (F.col(k) == F.col("to_k")))
    put = {"x": "to_x", "y": "to_y"}
    return moved.select(*(F.col(put.get(c, c)).alias(c) for c in clusters.columns)).unionByName(clusters.where("colour IS NULL"))


LAYOUT = "dataset long, barcode string, x double, y double"


def save_layout(places: DataFrame, path: str) -> None:
    """Write (dataset, barcode, x, y) as lines of four fields without a header, in order of dataset and barcode."""
    places.select("dataset", "barcode", "x", "y").orderBy("dataset", "barcode").write.csv(path)


def load_layout(cells: DataFrame, path: str) -> DataFrame:
    """Cells (dataset, barcode) with the places of a saved layout; it must hold just these cells.

    A line of other fields, another number of cells or a cell without a place is an error. A cell that
    is saved twice has one of its places, the greatest.
    """
    saved = cells.sparkSession.read.schema(LAYOUT).option("mode", "FAILFAST").csv(path)
    saved = saved.groupBy("dataset", "barcode").agg(F.max(F.struct("x", "y")).alias("at"))
    n, m = saved.count(), cells.count()
    if n != m:
        raise ValueError(f"the layout holds {n} cells, these data {m}")
    missing = F.raise_error(F.lit("the layout comes from other data"))
    return cells.join(saved, ["dataset", "barcode"], "left").select("dataset", "barcode", *(F.when(F.col("at").isNull(), missing).otherwise(F.col(f"at.{c}")).alias(c) for c in "xy"))


def dataset_colour(index: Column) -> Column:
    """The colour of a dataset by its index, one of 256."""
    return F.concat(F.lit("default-pre-"), F.pmod(index, F.lit(256)).cast("string"))


def finite(text: Column) -> Column:
    """text as a finite number, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def value_colour(cells: DataFrame, value: str, low: float | None = None, high: float | None = None, name: str = "colour") -> DataFrame:
    """cells with the shade of their value between low and high, where not given the least and greatest finite value of all cells; what isn't a finite number is 'undefined'.

    Values outside are moved to the border; if both ends are equal, shade 0 is taken.
    """
    x, lo, hi, at = fresh([*cells.columns, name], "x", "lo", "hi", "at")
    y = cells.withColumn(x, finite(F.col(value)))
    ends = y.agg(F.coalesce(F.lit(low).cast("double"), F.min(x)).alias(lo), F.coalesce(F.lit(high).cast("double"), F.max(x)).alias(hi))
    y = y.crossJoin(F.broadcast(ends)).withColumn(at, F.coalesce(scaled(F.col(x), F.col(lo), F.col(hi)), F.lit(0)))  # one row
    return y.withColumn(name, F.when(F.col(x).isNull(), "undefined").otherwise(F.concat(F.lit("turbo-pre-"), F.col(at).cast("long").cast("string")))).drop(x, lo, hi, at)


def isotype_colour(constants: Column, names: list[str], palette: list[str] | None = None) -> Column:
    """By the constant regions of a cell's heavy chains (null: unknown): 1 + the place of the only one among the sorted names, else 0; with a palette its colour.

    None, several, an unknown one or one that isn't among the names gives 0.
    """
    seen = F.array_distinct(constants)
    at = F.when(F.size(seen) == 1, F.coalesce(F.array_position(F.array(*map(F.lit, sorted(names))), F.get(seen, F.lit(0))), F.lit(0))).otherwise(0)
    return F.get(F.array(*map(F.lit, palette)), at.cast("int")) if palette else at.cast("string")


def mark_colour(chosen: Column, marked: Column) -> Column:
    """Red for cells of the chosen dataset, blue for others, pale where marked."""
    full, pale = ("red", "blue"), ("rgb(255,200,200)", "rgb(200,200,255)")
    pick = lambda pair: F.when(chosen, pair[0]).otherwise(pair[1])
    return F.when(marked, pick(pale)).otherwise(pick(full))


def assigned_colour(origin: Column, dataset: Column, barcode_colour: Column, origins: dict[str, str] | None = None, datasets: dict[str, str] | None = None) -> Column:
    """Colours given by the user: by origin if any is given, else by dataset if any is, else by barcode; black where none is."""
    for key, given in ((origin, origins), (dataset, datasets)):
        if given:
            return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in given.items() for x in kv)), key), F.lit("black"))
    return F.coalesce(barcode_colour, F.lit("black"))


def xy_points(rows: DataFrame, x: str, y: str, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """rows with px and py, the points of two variables, maybe logarithms of base 10; rows go where one isn't a number or has no logarithm."""
    out = rows.withColumn("px", F.col(x).try_cast("double")).withColumn("py", F.col(y).try_cast("double")).where("px IS NOT NULL AND py IS NOT NULL")
    for c, log in (("px", log_x), ("py", log_y)):
        out = out.where(F.col(c) > 0).withColumn(c, F.log10(c)) if log else out
    return out


#: Share of a border's value by which an axis goes beyond the points.
BEYOND = 0.02


def axis_ranges(points: DataFrame, symmetric: bool = False) -> DataFrame:
    """(x_low, x_high, y_low, y_high) of the axes that hold points (px, py); both alike if symmetric. No points, no row.

    Borders go 2 % of their value outwards; a positive low border that is under 2 % of the spread is 0.
    """
    out, sides = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("px", "py") for n, f in (("low", F.min), ("high", F.max)))).where("n > 0"), {}
    for c in ("px", "py"):
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        near = F.coalesce(F.try_divide(low, high - low) < BEYOND, F.lit(False))
        sides[c] = F.when(low <= 0, low * (1 + BEYOND)).when(near, 0.0).otherwise(low * (1 - BEYOND)), F.when(high > 0, high * (1 + BEYOND)).otherwise(high * (1 - BEYOND))
    (xl, xh), (yl, yh) = sides["px"], sides["py"]
    if symmetric:
        xl = yl = F.least(xl, yl)
        xh = yh = F.greatest(xh, yh)
    return out.select(xl.alias("x_low"), xh.alias("x_high"), yl.alias("y_low"), yh.alias("y_high"))
