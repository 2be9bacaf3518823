"""Operators on points and lines: equal spacing, spaced selection, similarity fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.operators import relational as R


def points_along(lines: DataFrame, key: str, line: str, step: float) -> DataFrame:
    """(key, k, x, y): the points at 0, step, 2 * step, ... along each line (array of x, y), up to its length.

    Keys are distinct. A line's segments share a task, as its vertices share a row; lines of no length give their first point.
    """
    ends = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = lines.where(F.size(line) > 1).select(key, F.posexplode(ends).alias("pos", "s")).select(key, "pos", "s.a", "s.b")
    rows = rows.withColumn("len", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.sum("len").over(before), F.lit(0.0))).where("len > 0 OR pos = 0")
    rows = rows.withColumn("to", F.col("from") + F.col("len"))
    first, last = F.ceil(F.col("from") / step), F.floor(F.col("to") / step)
    rows = rows.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    t = F.coalesce(F.try_divide(F.col("k") * step - F.col("from"), F.col("len")), F.lit(0.0))
    at = rows.select(key, "k", "pos", *[(F.col(f"a.{c}") + t * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in "xy"])
    # a vertex at a multiple of step ends one segment and starts the next
    return at.groupBy(key, "k").agg(F.min_by(F.struct("x", "y"), "pos").alias("p")).select(key, "k", "p.x", "p.y")


def spaced_top(points: DataFrame, group: str, order: list[str], most: int, spacing: float) -> DataFrame:
    """Of each group's points (x, y, ascending in the order), greedily up to `most` that lie `spacing` apart at least.

    The choice depends on all earlier ones, so a group (an image's points) is folded in one task.
    """

    def choose(frame):
        chosen = []
        for i, (x, y) in enumerate(zip(frame["x"], frame["y"])):
            if len(chosen) == most:
                break
            if all((x - u) ** 2 + (y - v) ** 2 >= spacing * spacing for _, u, v in chosen):
                chosen.append((i, x, y))
        return frame.iloc[[i for i, _, _ in chosen]]

    return points.groupBy(group).applyInPandas(lambda frame: choose(frame.sort_values(order, kind="stable")), points.schema)


def similarity_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a, b, tx, ty, scale, rms): the least-squares map u = a x - b y + tx, v = b x + a y + ty of pairs (x, y, u, v).

    Closed form from two rounds of sums, so a group of any size is combined map-side. Null where all points coincide. A null key has no fit.
    """
    means = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"])
    rows = pairs.join(means, keys)
    x, y, u, v = (F.col(c) - F.col(f"m{c}") for c in "xyuv")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x * x + y * y).alias("pp"), F.sum(u * u + v * v).alias("qq"), F.sum(x * u + y * v).alias("dot"), F.sum(x * v - y * u).alias("cross"), *[F.first(f"m{c}").alias(f"m{c}") for c in "xyuv"])
    fit = sums.withColumns({"a": F.try_divide("dot", "pp"), "b": F.try_divide("cross", "pp")})
    left = F.greatest(F.col("qq") - (F.col("a") * F.col("dot") + F.col("b") * F.col("cross")), F.lit(0.0))
    tx, ty = F.col("mu") - F.col("a") * F.col("mx") + F.col("b") * F.col("my"), F.col("mv") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")
    return fit.select(*keys, "n", "a", "b", tx.alias("tx"), ty.alias("ty"), F.hypot("a", "b").alias("scale"), F.sqrt(left / F.col("n")).alias("rms"))


def smallest_covering(points: DataFrame, polygons: DataFrame, unit: str, key: str, shape: str = "polygon") -> DataFrame:
    """points(unit, x, y, any others) with `key` of the smallest polygon of the same unit that meets the point, ties (areas equal in nine
    decimals) to the least key; points that none meets are left out.

    An equi-join on the unit, the polygon's box and the exact test behind it, and a minimum for each point: no lateral join.
    """
    boxed = polygons.where(F.size(shape) > 0).select(unit, F.col(key).alias("__key"), F.col(shape).alias("__shape"), G.bbox(F.col(shape)[0]).alias("__box"), F.round(G.polygon_area(F.col(shape)), 9).alias("__area"))
    near = points.join(boxed, unit).where(F.col("x").between(F.col("__box.minx"), F.col("__box.maxx")) & F.col("y").between(F.col("__box.miny"), F.col("__box.maxy")))
    hits = near.where(G.covers(F.col("__shape"), F.col("x"), F.col("y")))
    return hits.groupBy(*points.columns).agg(F.min_by("__key", F.struct("__area", "__key")).alias(key))


def around(boxes: DataFrame, key: str, box: str, targets: DataFrame, buffer: float) -> DataFrame:
    """(target, key): for each target key, the rows whose box meets the target's, expanded by buffer; the target itself too. Targets that
    are not in the table have none."""
    wide = boxes.join(targets.select(F.col(key)).distinct(), key, "left_semi").select(F.col(key).alias("target"), G.expand(F.col(box), buffer).alias("__wide"))
    return R.box_join(wide, boxes.select(key, F.col(box).alias("__own")), "__wide", "__own").select("target", key)


def meeting_box(polygons: DataFrame, shape: str, box: Column) -> DataFrame:
    """Polygons that share a point with a box: their own boxes first, then the exact test."""
    own = G.bbox(F.col(shape)[0])
    return polygons.where((F.size(shape) > 0) & G.overlaps(own, box)).where(G.meets_box(F.col(shape), box))


def touched(lines: DataFrame, polygons: DataFrame, line: str, shape: str) -> DataFrame:
    """Pairs of rows where a sampled point (array line of x, y) of the left lies in the right's polygon: boxes meet by grid, then points."""
    left = lines.where(F.size(line) > 0).withColumn("__lb", G.bbox(F.col(line)))
    right = polygons.where(F.size(shape) > 0).withColumn("__rb", G.bbox(F.col(shape)[0]))
    met = R.box_join(left, right, "__lb", "__rb")
    return met.where(F.exists(line, lambda p: G.covers(F.col(shape), p["x"], p["y"]))).drop("__lb", "__rb")


def mutual_best(pairs: DataFrame, left: str, right: str, cost: str) -> DataFrame:
    """Pairs in which each is the other's best, by least cost, ties to the least partner."""
    of_left = pairs.groupBy(left).agg(F.min_by(right, F.struct(cost, right)).alias("__r"))
    of_right = pairs.groupBy(right).agg(F.min_by(left, F.struct(cost, left)).alias("__l"))
    rows = pairs.join(of_left, left).where(F.col(right) == F.col("__r")).join(of_right, right).where(F.col(left) == F.col("__l"))
    return rows.select(*pairs.columns).distinct()


def ratio_matches(pairs: DataFrame, left: str, right: str, cost: str, ratio: float = 0.75) -> DataFrame:
    """Each left row's best partner where it is clearly better than the second: cost below ratio times the second's; alone ones pass not."""
    two = F.slice(F.array_sort(F.collect_list(F.struct(F.col(cost).alias("cost"), F.col(right).alias("right")))), 1, 2)
    best = pairs.groupBy(left).agg(two.alias("b")).where(F.size("b") == 2)
    return best.where(F.col("b")[0]["cost"] < ratio * F.col("b")[1]["cost"]).select(left, F.col("b")[0]["right"].alias(right), F.col("b")[0]["cost"].alias(cost))


def simplified(lines: DataFrame, line: str, tolerance: float) -> DataFrame:
    """lines with `line` (array of x, y) reduced by Douglas and Peucker: no dropped vertex is farther than tolerance from what is left."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def reduce(column):
        import numpy as np
        import pandas as pd

        def one(points):
            p = np.array([(q["x"], q["y"]) for q in points], float).reshape(-1, 2)
            keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
            while todo:
                a, b = todo.pop()
                if b - a < 2:
                    continue
                d, q = p[b] - p[a], p[a + 1 : b] - p[a]
                t = np.clip(q @ d / (d @ d), 0, 1)[:, None] if d @ d else 0.0
                away = np.hypot(*(q - t * d).T)
                k = int(away.argmax())
                if away[k] > tolerance:
                    keep.add(a + 1 + k)
                    todo += [(a, a + 1 + k), (a + 1 + k, b)]
            return [points[k] for k in sorted(keep)] if len(p) else []

        return pd.Series([None if v is None else one(list(v)) for v in column])

    return lines.withColumn(line, reduce(F.col(line)))


def raster_runs(polygons: DataFrame, shape: str, left: float, top: float, step: float, cols: int, rows: int) -> DataFrame:
    """polygons with (row, first, last): the runs of pixels whose middles lie in the polygon, by scan lines and the even-odd rule."""

    def of_row(r: Column) -> Column:
        y = F.lit(top) - (r + 0.5) * step
        ends = lambda ring: F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.when((a["y"] > y) != (b["y"] > y), a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"])))
        xs = F.array_sort(F.array_compact(F.flatten(F.transform(F.col(shape), ends))))
        pixel = lambda x: F.ceil((x - left) / step - 0.5)  # noqa: E731  the first whose middle is at x or right of it
        pair = lambda x, i: F.struct(r.alias("row"), F.greatest(F.lit(0), pixel(x)).alias("first"), F.least(F.lit(cols), pixel(F.get(xs, i + 1))).alias("end"), i.alias("i"))
        return F.filter(F.transform(xs, pair), lambda s: (s["i"] % 2 == 0) & (s["first"] < s["end"]))

    box = G.bbox(F.col(shape)[0])
    low = F.greatest(F.lit(0), F.floor((F.lit(top) - box["maxy"]) / step)).cast("int")
    high = F.least(F.lit(rows - 1), F.ceil((F.lit(top) - box["miny"]) / step)).cast("int")
    lines = polygons.where(F.size(shape) > 0).withColumn("__r", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("__s", F.explode(of_row(F.col("__r"))))
    return lines.select(*polygons.columns, F.col("__s.row").alias("row"), F.col("__s.first").alias("first"), (F.col("__s.end") - 1).alias("last"))


def icp_fits(points: DataFrame, key: str, rounds: int = 30, reject: float = 3.0, least: int = 4, gate: float | None = None) -> DataFrame:
    """(key, a, b, tx, ty, rms, used, accepted): the similarity that brings each group's source points onto its targets.

    points: (key, kind 'source' or 'target', x, y). Nearest neighbours are matched, matches farther from the median distance than
    `reject` median deviations left out, and the closed-form fit repeated until it stands still. Accepted: at least `least`
    matches and an rms up to `gate`. A group is an image's points, so it fits one task.
    """

    def fit(frame):
        import numpy as np
        import pandas as pd

        p = frame.loc[frame["kind"] == "source", ["x", "y"]].to_numpy() @ [1, 1j]
        q = frame.loc[frame["kind"] == "target", ["x", "y"]].to_numpy() @ [1, 1j]
        m, t, rms, used = 1 + 0j, 0j, float("nan"), 0
        if len(p) >= 2 and len(q) >= 2:
            t, last = q.mean() - p.mean(), None
            for _ in range(rounds):
                moved = m * p + t
                near = np.concatenate([np.abs(moved[k : k + 512, None] - q).argmin(1) for k in range(0, len(p), 512)])
                d = np.abs(moved - q[near])
                mid = np.median(d)
                ok = np.abs(d - mid) <= reject * max(np.median(np.abs(d - mid)), 1e-12)
                u, v = p[ok], q[near[ok]]
                du, dv = u - u.mean(), v - v.mean()
                if len(u) < 2 or not (np.abs(du) ** 2).sum():
                    break
                m = (du.conj() * dv).sum() / (np.abs(du) ** 2).sum()
                t = v.mean() - m * u.mean()
                rms, used = float(np.sqrt((np.abs(m * u + t - v) ** 2).mean())), int(ok.sum())
                if last is not None and abs(last - rms) < 1e-12:
                    break
                last = rms
        good = bool(used >= least and (gate is None or rms <= gate))
        return pd.DataFrame({key: [frame[key].iloc[0]], "a": [m.real], "b": [m.imag], "tx": [t.real], "ty": [t.imag], "rms": [rms], "used": [used], "accepted": [good]})

    kind = points.schema[key].dataType.simpleString()
    return points.groupBy(key).applyInPandas(fit, f"{key} {kind}, a double, b double, tx double, ty double, rms double, used int, accepted boolean")


def shifts(images: DataFrame, key: str) -> DataFrame:
    """(key, dx, dy, peak): how far `second` is moved against `first` (arrays of rows of numbers, of one size), by the peak of their
    cross-correlation in the frequency domain, refined by a parabola through its neighbours."""

    def one(first, second):
        import numpy as np

        a, b = (np.array([list(r) for r in m], float) for m in (first, second))
        c = np.fft.ifft2(np.fft.fft2(b - b.mean()) * np.fft.fft2(a - a.mean()).conj()).real
        at = np.unravel_index(c.argmax(), c.shape)
        out = []
        for axis, k in enumerate(at):
            n = c.shape[axis]
            before, here, after = (c[tuple((k + d) % n if x == axis else at[x] for x in (0, 1))] for d in (-1, 0, 1))
            bend = before - 2 * here + after
            k = k + (0.5 * (before - after) / bend if bend else 0.0)
            out.append(k - n if k > n / 2 else k)
        scale = np.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum())
        return float(out[1]), float(out[0]), float(c.max() / scale) if scale else 0.0

    @F.pandas_udf("dx double, dy double, peak double")
    def found(first, second):
        import pandas as pd

        return pd.DataFrame([one(a, b) for a, b in zip(first, second)], columns=["dx", "dy", "peak"])

    from pyspark.sql.functions import col

    return images.select(key, found(col("first"), col("second")).alias("s")).select(key, "s.*")


def placements(sheets: DataFrame, unit: str, order: str, box: str, step: float) -> DataFrame:
    """sheets with (left, top, right, bottom) in pixels of their unit's mosaic, covered(array of keys) being the later sheets that
    overwrite some of it. The mosaic's corner is the least x and the greatest y of its sheets."""
    w = W.partitionBy(unit)
    rows = sheets.withColumn("__minx", F.min(F.col(box)["minx"]).over(w)).withColumn("__maxy", F.max(F.col(box)["maxy"]).over(w))
    pixel = lambda v: F.rint(v / step).cast("long")
    rows = rows.withColumn("left", pixel(F.col(box)["minx"] - F.col("__minx"))).withColumn("top", pixel(F.col("__maxy") - F.col(box)["maxy"]))
    rows = rows.withColumn("right", pixel(F.col(box)["maxx"] - F.col("__minx"))).withColumn("bottom", pixel(F.col("__maxy") - F.col(box)["miny"])).drop("__minx", "__maxy")
    mine, later = rows.select(unit, order, "left", "top", "right", "bottom"), rows.select(unit, F.col(order).alias("__o"), *[F.col(c).alias(f"__{c}") for c in ("left", "top", "right", "bottom")])
    over = mine.join(later, unit).where((F.col("__o") > F.col(order)) & (F.col("__left") < F.col("right")) & (F.col("__right") > F.col("left")) & (F.col("__top") < F.col("bottom")) & (F.col("__bottom") > F.col("top")))
    over = over.groupBy(unit, order).agg(F.array_sort(F.collect_list("__o")).alias("covered"))
    return rows.join(over, [unit, order], "left").withColumn("covered", F.coalesce("covered", F.array().cast(over.schema["covered"].dataType)))


def dark_frames(profiles: DataFrame, column: str = "profile", drop: float = 70.0, floor: float = 130.0, gap: int = 3) -> DataFrame:
    """profiles with `runs` (first, last, depth) of a brightness profile's dark stretches: below the 95th percentile less `drop` (at
    least `floor`); stretches up to `gap` apart are one."""

    def of(values: Column) -> Column:
        ordered = F.array_sort(values)
        at = 0.95 * (F.size(values) - 1)
        low = F.get(ordered, F.floor(at).cast("int"))
        p95 = low + (at - F.floor(at)) * (F.coalesce(F.get(ordered, F.ceil(at).cast("int")), low) - low)
        limit = F.greatest(p95 - drop, F.lit(floor))
        dark = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), (limit - v).alias("d"))), lambda s: s["d"] > 0)
        empty = F.array().cast("array<struct<first:int,last:int,depth:double>>")
        fresh = lambda s: F.struct(s["i"].cast("int").alias("first"), s["i"].cast("int").alias("last"), s["d"].cast("double").alias("depth"))

        def step(runs: Column, s: Column) -> Column:
            last = F.get(runs, F.size(runs) - 1)
            grown = F.struct(last["first"].alias("first"), s["i"].cast("int").alias("last"), F.greatest(last["depth"], s["d"].cast("double")).alias("depth"))
            joins = (F.size(runs) > 0) & (s["i"] - last["last"] <= gap)
            return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(fresh(s))))

        return F.aggregate(dark, empty, step)

    return profiles.withColumn("runs", F.transform(F.array(F.col(column)), of)[0])


def merged_lines(centres: Column, gap: float) -> Column:
    """Line centres in order, those closer than gap to the running middle of the one before being merged into it (their mean)."""
    empty = F.array().cast("array<struct<at:double,n:int>>")

    def step(lines: Column, v: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        wider = F.struct(((last["at"] * last["n"] + v) / (last["n"] + 1)).alias("at"), (last["n"] + 1).alias("n"))
        near = (F.size(lines) > 0) & (v - last["at"] < gap)
        return F.when(near, F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(lines, F.array(F.struct(v.cast("double").alias("at"), F.lit(1).alias("n")))))

    return F.transform(F.aggregate(F.array_sort(centres), empty, step), lambda s: s["at"])
