"""Ordered point operators per path.

Points: path_id, seq (0..n-1), x, y, closed; closed paths wrap around. A path may be
of any length: it is cut into blocks of consecutive points, each with as many points of its
neighbours around it as an operator looks ahead, so one path takes many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.operators.ordered import map_whole_groups, new_groups, running_sums
from mosaiq.session import cut_lineage, meet

# Smoothing and scoring constants.
TAUBIN_LAMBDA, TAUBIN_MU, TAUBIN_ITERS = 0.33, -0.34, 5
CORNER_DEG, CORNER_WINDOW, MIN_ANCHORS, MAX_MOVE, MIN_BOX = 50.0, 2, 10, 1.1, 22.0
AXIS_TARGETS = [0.0, 45.0, 90.0, 135.0]

BLOCK = 1 << 15
"""Points of a block that windows run over."""
CHAIN_BLOCK = 1 << 12
"""Points of a block whose chain of kept points is followed at once."""


def per_block(totals: DataFrame, block: int) -> DataFrame:
    """A row of ``totals(path_id, _n, ...)`` for each block of its path, so that a long path meets it under many keys."""
    return totals.withColumn("_home", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))))


def with_totals(points: DataFrame, totals: DataFrame, block: int) -> DataFrame:
    """Joins what is known of whole paths (with their length ``_n``) to points, block by block. A null path_id is a path."""
    known = per_block(totals, block).withColumnRenamed("path_id", "_path").withColumnRenamed("_home", "_at")
    at = points.withColumn("_home", F.floor(F.col("seq") / block))
    return at.join(known, at["path_id"].eqNullSafe(known["_path"]) & (at["_home"] == known["_at"])).drop("_path", "_home", "_at")


def blocked(points: DataFrame, halo: int, block: int | None = None, **totals: Column) -> DataFrame:
    """Points copied to every block that sees them, with the block ``_blk``, the place ``_s`` in it and ``_n``, the path's length.

    A block sees ``halo`` points before and after its own; on a closed path they go round, at places below 0 or from
    ``_n`` on. ``_core`` marks a block's own points. ``totals`` are aggregates of the whole path to add.
    """
    block = BLOCK if block is None else block
    length = points.groupBy("path_id").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in totals.items()])
    df = with_totals(points, length, block)
    rounds = F.ceil(F.lit(halo) / F.col("_n"))
    turn = F.explode(F.when(F.col("closed"), F.sequence(-rounds, rounds)).otherwise(F.array(F.lit(0).cast("long"))))
    df = df.withColumn("_turn", turn).withColumn("_s", F.col("seq") + F.col("_turn") * F.col("_n")).drop("_turn")
    df = df.where((F.col("_s") >= -halo) & (F.col("_s") < F.col("_n") + halo))
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_s") - halo) / block))
    high = F.least(F.floor((F.col("_n") - 1) / block), F.floor((F.col("_s") + halo) / block))
    df = df.withColumn("_blk", F.explode(F.sequence(low, high)))
    end = F.least((F.col("_blk") + 1) * block, F.col("_n"))
    return df.withColumn("_core", (F.col("_s") >= F.col("_blk") * block) & (F.col("_s") < end))


def path_window():
    return Window.partitionBy("path_id", "_blk").orderBy("_s")


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_core", "_s", "_blk")


def neighbour(c: str, k: int) -> Column:
    """Value k points ahead in a blocked table with a halo of k or more, null beyond open ends."""
    return F.col(c) if k == 0 else F.lead(c, k).over(path_window()) if k > 0 else F.lag(c, -k).over(path_window())


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Turn in degrees between two vectors, 0 if either is null-length."""
    na, nb = F.hypot(ax, ay), F.hypot(bx, by)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (na * nb)))
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(F.degrees(F.acos(cos)))


def with_neighbours(points: DataFrame, k: int = 1, block: int | None = None) -> DataFrame:
    """Adds px, py (k back), nx, ny (k ahead) and the path's length ``_n``."""
    df = blocked(points, k, block)
    return core(df.select("*", neighbour("x", -k).alias("px"), neighbour("y", -k).alias("py"), neighbour("x", k).alias("nx"), neighbour("y", k).alias("ny")))


def _turn() -> Column:
    t = angle_between(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    return F.coalesce(t, F.lit(0.0))


def turn_angle(points: DataFrame, k: int = 1, block: int | None = None) -> DataFrame:
    """Adds ``turn``: windowed turn at each point, 0 near open ends."""
    return with_neighbours(points, k, block).withColumn("turn", _turn()).drop("px", "py", "nx", "ny", "_n")


def _follow(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """For each point the next one farther than ``tol`` away, len(x) if there is none."""
    n = len(x)
    follow, waiting, ahead = np.full(n + 1, n), np.arange(n), 1
    while len(waiting):
        waiting = waiting[waiting + ahead < n]
        far = np.hypot(x[waiting + ahead] - x[waiting], y[waiting + ahead] - y[waiting]) > tol
        follow[waiting[far]] = waiting[far] + ahead
        waiting, ahead = waiting[~far], ahead + 1
    return follow


def _last_of_chain(follow: np.ndarray) -> np.ndarray:
    """For each point the last one of the walk that begins at it."""
    n = len(follow) - 1
    last, jump = np.arange(n + 1), follow.copy()
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)  # twice the steps in every round
        jump = jump[jump]
    return last[:n]


def _chain(follow: np.ndarray, start: int) -> np.ndarray:
    """The points of the walk from ``start``."""
    n = len(follow) - 1
    mark = np.zeros(n + 1, dtype=bool)
    mark[start] = True
    while True:
        mark[follow[np.flatnonzero(mark[:n])]] = True
        if (follow == n).all():
            return mark[:n]
        follow = follow[follow]


def _walk_whole(tol: float):
    """Kept points of many whole paths, each row of arrays a path: all of them take a step at once."""
    def walk(t: pa.Table) -> pa.Table:
        x, y = (t.column(c).to_numpy().astype(float) for c in ("x", "y"))
        first = np.flatnonzero(new_groups(t, ("path_id",)))
        size = np.diff(np.append(first, t.num_rows))
        at, number = first.copy(), np.full(t.num_rows, -1, dtype=np.int32)
        count, live = np.ones(len(first), dtype=np.int32), np.arange(len(first))
        number[first] = 0
        for step in range(1, int(size.max())):
            live = live[size[live] > step]
            here = first[live] + step
            far = np.hypot(x[here] - x[at[live]], y[here] - y[at[live]]) > tol
            hit = live[far]
            number[here[far]], at[hit] = count[hit], here[far]
            count[hit] += 1
        closing = (count > 1) & (np.hypot(x[at] - x[first], y[at] - y[first]) <= tol)
        number[at[closing]] = -1
        kept = np.flatnonzero(number >= 0)
        out = t.take(pa.array(kept))
        return pa.table({"path_id": out["path_id"], "seq": number[kept], "x": x[kept], "y": y[kept], "closed": out["closed"], "source_seq": out["seq"]})

    return walk


def dedupe_points(points: DataFrame, tol: float = 0.6, block: int | None = None) -> DataFrame:
    """Drop points within ``tol`` of the last kept one, and a last point equal to the first.

    Each point depends on the last one kept before it. A block of a path says at which points walks
    through it can end; the next block says for each of these where a walk that comes from it ends. These small tables,
    chained from the first block on, give the point from which each block is really entered, and all
    blocks then drop their points at the same time. A walk that keeps nothing in a block enters the next one as it came.
    Paths that lie in one block need no chain and are walked many at once.
    """
    block = CHAIN_BLOCK if block is None else block
    kinds = dict(points.dtypes)
    cut = cut_lineage(points.select("path_id", "seq", "x", "y", "closed", F.floor(F.col("seq") / block).alias("blk")))
    many = cut_lineage(cut.groupBy("path_id").agg(F.min("blk").alias("a"), F.max("blk").alias("b")).where("a < b").select("path_id"))
    longer = not many.isEmpty()
    whole = meet(cut, many, ["path_id"], "left_anti") if longer else cut
    schema = f"path_id {kinds['path_id']}, seq int, x double, y double, closed {kinds['closed']}, source_seq {kinds['seq']}"
    walked = map_whole_groups(whole.select("path_id", "seq", "x", "y", "closed"), ["path_id"], ["seq"], _walk_whole(tol), schema)
    return walked.unionByName(_dedupe_blocks(meet(cut, many, ["path_id"], "left_semi"), kinds, tol)) if longer else walked


def _dedupe_blocks(points: DataFrame, kinds: dict[str, str], tol: float) -> DataFrame:
    """``dedupe_points`` of paths cut into blocks ``blk``."""
    pts = cut_lineage(points)
    entry = f"path_id {kinds['path_id']}, blk long, es {kinds['seq']}, ex double, ey double"
    table = f"path_id {kinds['path_id']}, blk long, es {kinds['seq']}, ls {kinds['seq']}, ex double, ey double, lx double, ly double, passed boolean"

    def arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("seq", ignore_index=True)
        x, y = pdf["x"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float)
        return pdf, x, y, _follow(x, y, tol)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, follow = arrays(pdf)
        last = _last_of_chain(follow)
        at = np.unique(last[:1] if pdf["blk"].iloc[0] == 0 else last)
        out = pdf.iloc[at]
        return pd.DataFrame({"path_id": out["path_id"], "blk": out["blk"] + 1, "es": out["seq"], "ex": out["x"], "ey": out["y"]})

    def through(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(entries):
            return pd.DataFrame(columns=["path_id", "blk", "es", "ls", "ex", "ey", "lx", "ly", "passed"])
        pdf, x, y, follow = arrays(pdf)
        last = _last_of_chain(follow)
        far = [np.hypot(x - ex, y - ey) > tol for ex, ey in zip(entries["ex"], entries["ey"])]
        passed = np.array([not f.any() for f in far])
        at = last[[int(f.argmax()) for f in far]]
        to = pdf.iloc[at]
        pick = lambda own, new: np.where(passed, entries[own].to_numpy(), to[new].to_numpy())
        return entries.assign(ls=pick("es", "seq"), lx=pick("ex", "x"), ly=pick("ey", "y"), passed=passed)[["path_id", "blk", "es", "ls", "ex", "ey", "lx", "ly", "passed"]]

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at = [], None
        for blk, part in pdf.groupby("blk", sort=True):
            row = part if at is None else part[part["es"] == at]
            rows.append(row.head(1))
            at = row["ls"].iloc[0]
        return pd.concat(rows)[["path_id", "blk", "es", "ex", "ey"]]

    def keep(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["path_id", "seq", "x", "y", "closed"])
        pdf, x, y, follow = arrays(pdf)
        start = 0
        if len(entries):
            far = np.hypot(x - entries["ex"].iloc[0], y - entries["ey"].iloc[0]) > tol
            start = int(far.argmax()) if far.any() else len(x)
        return pdf[_chain(follow, start)][["path_id", "seq", "x", "y", "closed"]]

    def both(a: DataFrame, b: DataFrame, fn, schema: str) -> DataFrame:
        return a.groupBy("path_id", "blk").cogroup(b.groupBy("path_id", "blk")).applyInPandas(fn, schema)

    blocks = pts.select("path_id", "blk").distinct()
    tables, new = None, pts.groupBy("path_id", "blk").applyInPandas(ends, entry).join(blocks, ["path_id", "blk"], "left_semi")
    while True:
        new = cut_lineage(new)
        if tables is not None and new.isEmpty():
            break
        # only blocks that have something to answer are read again
        asked = pts if tables is None else pts.join(new.select("path_id", "blk").distinct(), ["path_id", "blk"], "left_semi")
        found = cut_lineage(both(asked, new, through, table))
        tables = found if tables is None else tables.unionByName(found)
        new = found.where("passed").select("path_id", (F.col("blk") + 1).alias("blk"), F.col("ls").alias("es"), F.col("lx").alias("ex"), F.col("ly").alias("ey"))
        new = new.join(blocks, ["path_id", "blk"], "left_semi")
    enters = cut_lineage(tables.groupBy("path_id").applyInPandas(entered, entry))
    chosen = both(pts, enters, keep, f"path_id {kinds['path_id']}, seq {kinds['seq']}, x double, y double, closed {kinds['closed']}")
    placed = cut_lineage(running_sums(chosen.withColumn("_one", F.lit(1).cast("long")), ["path_id"], ["seq"], "_one", "_new"))
    ring = placed.groupBy("path_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y", "_new"), "seq").alias("b"))
    ring = ring.where((F.col("b._new") > 0) & (F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) <= tol)).select("path_id", F.col("b._new").alias("_new"))
    left = placed.join(ring, placed["path_id"].eqNullSafe(ring["path_id"]) & (placed["_new"] == ring["_new"]), "left_anti")
    return left.select("path_id", F.col("_new").cast("int").alias("seq"), "x", "y", "closed", F.col("seq").alias("source_seq"))


def merge_collinear(points: DataFrame, tol_deg: float, block: int | None = None) -> DataFrame:
    """Drop points turning less than ``tol_deg``; a path that would keep fewer than 3 is unchanged."""
    n = F.col("_n")
    end = ~F.col("closed") & ((F.col("seq") == 0) | (F.col("seq") == n - 1))
    df = cut_lineage(with_neighbours(points, 1, block).withColumn("_keep", end | (_turn() >= tol_deg) | (n < 3)).select(*points.columns, "_keep", "_n"))
    few = df.groupBy("path_id").agg(F.first("_n").alias("_n"), F.count_if("_keep").alias("_left")).where("_left < 3")
    lost = with_totals(df.where(~F.col("_keep")).drop("_n"), few, BLOCK if block is None else block)
    return df.where("_keep").select(*points.columns).unionByName(lost.select(*points.columns))


def segments(points: DataFrame, block: int | None = None) -> DataFrame:
    """One row per segment to the next point (closing segment on closed paths): dx, dy, len, angle mod 180; the path's length ``_n``."""
    df = blocked(points, 1, block)
    df = core(df.select("*", neighbour("x", 1).alias("nx"), neighbour("y", 1).alias("ny"))).where(F.col("nx").isNotNull())
    df = df.withColumn("dx", F.col("nx") - F.col("x")).withColumn("dy", F.col("ny") - F.col("y"))
    return df.withColumn("len", F.hypot("dx", "dy")).withColumn("angle", F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0)))


def _chain_means(df: DataFrame, links: dict[str, tuple[str, str]], block: int) -> DataFrame:
    """Means over maximal runs of linked consecutive points (wrapping on closed paths): ``links = {out: (link, value)}``.

    A link says whether a point is tied to the next one. A run is named by its first point; its sums are taken block by block,
    added up, and sent back to each block that the run passes.
    """
    df = df.withColumn("_home", F.floor(F.col("seq") / block))
    inside = Window.partitionBy("path_id", "_home").orderBy("seq")
    path = Window.partitionBy("path_id").orderBy("_home")
    for out, (link, value) in links.items():
        # a point opens a run unless the one before it is tied to it
        opened = df.withColumn("_open", F.when(~F.col(f"{link}_before"), F.col("seq")))
        opened = cut_lineage(opened.withColumn("_here", F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
        tops = opened.groupBy("path_id", "_home").agg(F.max("_open").alias("_top"), F.max(F.when(F.col("closed") & (F.col("seq") == F.col("_n") - 1), F.col(link))).alias("_wraps"))
        carried = tops.select("path_id", "_home", F.coalesce(F.max("_top").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("_carry"))
        runs = opened.join(carried, ["path_id", "_home"]).withColumn("_run", F.coalesce("_here", "_carry"))
        sums = runs.groupBy("path_id", "_home", "_run").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_cnt"))
        # the run open at a closed path's end goes on at its beginning: the part without an opening, or the one that opens at 0
        last = tops.groupBy("path_id").agg(F.max("_top").alias("_last"), F.max("_wraps").alias("_wraps")).where("_wraps and _last is not null")
        sums = cut_lineage(sums)
        whole = sums.join(last, "path_id", "left").withColumn("_name", F.when((F.col("_run") == F.col("_last")) & F.col("_wraps"), -1).otherwise(F.col("_run")))
        named = cut_lineage(whole.select("path_id", "_home", "_run", "_name", "_sum", "_cnt"))
        mean = named.groupBy("path_id", "_name").agg((F.sum("_sum") / F.sum("_cnt")).alias(out))
        df = runs.join(named.join(mean, ["path_id", "_name"]).select("path_id", "_home", "_run", out), ["path_id", "_home", "_run"]).drop("_open", "_here", "_carry", "_run")
    return df


def snap_axis_groups(points: DataFrame, tol_deg: float, block: int | None = None) -> DataFrame:
    """Chains of near-horizontal segments share their mean y, near-vertical ones their mean x."""
    block = BLOCK if block is None else block
    df = blocked(points, 1, block)
    df = df.select("*", neighbour("x", 1).alias("nx"), neighbour("y", 1).alias("ny"))
    ang = F.pmod(F.degrees(F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x"))), F.lit(180.0))
    tied = {"_h": F.least(ang, 180.0 - ang) <= tol_deg, "_v": F.abs(ang - 90.0) <= tol_deg}
    df = df.select(*points.columns, "_n", "_core", "_s", "_blk", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in tied.items()])
    df = cut_lineage(core(df.select("*", *[F.coalesce(F.lag(k).over(path_window()), F.lit(False)).alias(f"{k}_before") for k in tied])))
    df = _chain_means(df, {"_y": ("_h", "y"), "_x": ("_v", "x")}, block)
    return df.select("path_id", "seq", F.col("_x").alias("x"), F.col("_y").alias("y"), "closed")


def snap_angle(angle: Column, targets: list[float], tol: float) -> Column:
    """Nearest target direction (mod 180) within ``tol``, the last of equal ones; else null."""
    a = F.pmod(angle, F.lit(180.0))
    best = None
    for i, t in enumerate(targets):
        d = F.abs(a - (t % 180.0))
        item = F.struct(F.least(d, 180.0 - d).alias("d"), F.lit(-i).alias("o"), F.lit(float(t)).alias("t"))
        best = item if best is None else F.least(best, item)
    return F.when(best["d"] <= tol, best["t"])


def snap_diagonal(points: DataFrame, tol_deg: float, block: int | None = None) -> DataFrame:
    """Near-diagonal segments turn onto 45/135 degrees around their midpoint; shared points average."""
    s = segments(points, block).where(F.col("len") >= 1e-6)
    s = s.withColumn("_t", snap_angle(F.col("angle"), [45.0, 135.0], tol_deg))
    mx, my = (F.col("x") + F.col("nx")) / 2, (F.col("y") + F.col("ny")) / 2
    ux, uy = F.cos(F.radians("_t")), F.sin(F.radians("_t"))
    def project(x: Column, y: Column) -> tuple[Column, Column]:
        t = (x - mx) * ux + (y - my) * uy
        return F.coalesce(mx + t * ux, x), F.coalesce(my + t * uy, y)
    ax, ay = project(F.col("x"), F.col("y"))
    bx, by = project(F.col("nx"), F.col("ny"))
    votes = s.select("path_id", F.explode(F.array(
        F.struct(F.col("seq").alias("seq"), ax.alias("x"), ay.alias("y")),
        F.struct(F.pmod(F.col("seq") + 1, F.col("_n")).cast("int").alias("seq"), bx.alias("x"), by.alias("y")),
    )).alias("v"))
    mean = votes.groupBy("path_id", F.col("v.seq").alias("seq")).agg(F.avg("v.x").alias("_x"), F.avg("v.y").alias("_y"))
    return points.join(mean, ["path_id", "seq"], "left").select(
        "path_id", "seq", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), "closed"
    )


def corner_intersections(points: DataFrame, tol_deg: float, block: int | None = None) -> DataFrame:
    """Move corners between two near-axis segments onto the crossing of their neighbours' lines.

    All corners move at once from the input points.
    """
    df = with_neighbours(points, 1, block)
    ang = lambda ax, ay, bx, by: F.pmod(F.degrees(F.atan2(by - ay, bx - ax)), F.lit(180.0))
    c = F.col
    a1, a2 = ang(c("px"), c("py"), c("x"), c("y")), ang(c("x"), c("y"), c("nx"), c("ny"))
    axis = lambda a: (F.least(a, 180.0 - a) <= tol_deg) | (F.abs(a - 90.0) <= tol_deg)
    den = (c("px") - c("x")) * (c("y") - c("ny")) - (c("py") - c("y")) * (c("x") - c("nx"))
    p = c("px") * c("y") - c("py") * c("x")
    q = c("x") * c("ny") - c("y") * c("nx")
    ix, iy = (p * (c("x") - c("nx")) - (c("px") - c("x")) * q) / den, (p * (c("y") - c("ny")) - (c("py") - c("y")) * q) / den
    reach = F.greatest(F.hypot(c("x") - c("px"), c("y") - c("py")), F.hypot(c("nx") - c("x"), c("ny") - c("y")))
    ok = F.coalesce((c("_n") >= 4) & axis(a1) & axis(a2) & (F.abs(den) >= 1e-9) & (F.hypot(ix - c("x"), iy - c("y")) < reach), F.lit(False))
    return df.select("path_id", "seq", F.when(ok, ix).otherwise(c("x")).alias("x"), F.when(ok, iy).otherwise(c("y")).alias("y"), "closed")


def run_stats(points: DataFrame, block: int | None = None) -> DataFrame:
    """Segment and vertex counts per path plus straightness, axis, corner and geometry scores (0..1).

    Runs are read as open polylines: end points have no vertex.
    """
    run = points.withColumn("closed", F.lit(False))
    seg = segments(run, block).where(F.col("len") >= 1e-9).groupBy("path_id").agg(
        F.count(F.lit(1)).alias("seg"), F.count_if(F.col("len") < 2.5).alias("short"), F.sum("len").alias("total_len"),
        F.coalesce(F.sum(F.when(snap_angle(F.col("angle"), AXIS_TARGETS, 6.0).isNotNull(), F.col("len"))), F.lit(0.0)).alias("aligned_len"),
    )
    t = with_neighbours(run, 1, block).where(F.col("px").isNotNull() & F.col("nx").isNotNull())
    t = t.withColumn("turn", angle_between(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    vert = t.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("verts"), F.count_if(F.col("turn").between(25.0, 150.0)).alias("corner_v"),
        F.count_if((F.col("turn") >= 3.0) & (F.col("turn") < 25.0)).alias("facet_v"), F.count_if(F.col("turn") > 150.0).alias("dirty_v"),
    )
    base = points.select("path_id").distinct().join(seg, "path_id", "left").join(vert, "path_id", "left").na.fill(0)
    return with_scores(base)


def with_scores(stats: DataFrame) -> DataFrame:
    c = F.col
    one = lambda n: F.greatest(c(n), F.lit(1))
    short = c("short") / one("seg")
    straight = F.when((c("verts") == 0) & (c("seg") == 0), 0.85).otherwise(F.bround(F.greatest(F.lit(0.0), 1.0 - c("facet_v") / one("verts") * 0.7 - short * 0.5), 4))
    axis = F.when(c("total_len") <= 1e-6, 0.85).otherwise(F.bround(F.least(F.lit(1.0), c("aligned_len") / c("total_len")), 4))
    corner = F.when(c("verts") == 0, 0.9).otherwise(F.bround(F.greatest(F.lit(0.0), 1.0 - (c("dirty_v") / one("verts") + short)), 4))
    df = stats.select("*", straight.alias("straight_edge_score"), axis.alias("axis_alignment_score"), corner.alias("corner_cleanliness_score"))
    return df.withColumn("geometry_score", F.bround((c("straight_edge_score") + c("axis_alignment_score") + c("corner_cleanliness_score")) / 3.0, 4))


def taubin_smooth(points: DataFrame, iters: int = TAUBIN_ITERS, block: int | None = None) -> DataFrame:
    """Shrink-free smoothing with frozen corners and ends; moves are capped.

    A point depends on as many points around it as there are passes, so blocks with that halo are
    smoothed apart, all passes on one partitioning.
    """
    box = F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    df = blocked(points, 2 * iters + CORNER_WINDOW, block, _box=box)
    k = CORNER_WINDOW
    df = df.select("*", neighbour("x", -k).alias("px"), neighbour("y", -k).alias("py"), neighbour("x", k).alias("nx"), neighbour("y", k).alias("ny"))
    end = ~F.col("closed") & ((F.col("seq") == 0) | (F.col("seq") == F.col("_n") - 1))
    move = (F.col("_n") >= MIN_ANCHORS) & (F.col("_box") >= MIN_BOX) & ~end & (_turn() <= CORNER_DEG)
    keys = [*points.columns, "_core", "_s", "_blk"]
    df = df.select(*keys, move.alias("_move"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    for _ in range(iters):
        for factor in (TAUBIN_LAMBDA, TAUBIN_MU):
            cols = []
            for v in ("_x", "_y"):
                back = F.coalesce(F.lag(v).over(path_window()), F.col(v))
                ahead = F.coalesce(F.lead(v).over(path_window()), F.col(v))
                cols.append(F.when(F.col("_move"), F.col(v) + ((back + ahead) * 0.5 - F.col(v)) * factor).otherwise(F.col(v)).alias(v))
            df = df.select(*keys, "_move", *cols)
    df = core(df)
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    d = F.hypot(dx, dy)
    s = F.when(d > MAX_MOVE, F.lit(MAX_MOVE) / d).otherwise(1.0)
    return df.select("path_id", "seq", (F.col("x") + dx * s).alias("x"), (F.col("y") + dy * s).alias("y"), "closed", (d > 0.05).alias("moved"))


def joints(segs: DataFrame, block: int | None = None) -> DataFrame:
    """Turn at each joint of consecutive cubic segments.

    segs(path_id, seq, kind, c1x, c1y, c2x, c2y, ex, ey, closed); both sides of a
    joint must be cubic.
    """
    nxt = lambda c: neighbour(c, 1)
    df = core(blocked(segs, 1, block).select("*", nxt("kind").alias("_k"), nxt("c1x").alias("_nx"), nxt("c1y").alias("_ny"))).where((F.col("kind") == "C") & (F.col("_k") == "C"))
    turn = angle_between(F.col("ex") - F.col("c2x"), F.col("ey") - F.col("c2y"), F.col("_nx") - F.col("ex"), F.col("_ny") - F.col("ey"))
    return df.withColumn("turn", turn)


def curve_kinks(segs: DataFrame, low: float = 1.5, high: float = 25.0) -> DataFrame:
    """Kinks (low < turn <= high) and cubic joints per path."""
    g = joints(segs).groupBy("path_id").agg(F.count_if((F.col("turn") > low) & (F.col("turn") <= high)).alias("kinks"), F.count(F.lit(1)).alias("joints"))
    return segs.select("path_id").distinct().join(g, "path_id", "left").na.fill(0)


def fair_joints(segs: DataFrame, low: float = 1.5, high: float = 25.0, block: int | None = None) -> DataFrame:
    """Turn both control points of each kink onto the common tangent (all joints at once)."""
    j = joints(segs, block).where((F.col("turn") > low) & (F.col("turn") <= high))
    c = F.col
    lin, lout = F.hypot(c("ex") - c("c2x"), c("ey") - c("c2y")), F.hypot(c("_nx") - c("ex"), c("_ny") - c("ey"))
    bx, by = (c("ex") - c("c2x")) / lin + (c("_nx") - c("ex")) / lout, (c("ey") - c("c2y")) / lin + (c("_ny") - c("ey")) / lout
    nb = F.hypot(bx, by)
    j = j.select(
        "path_id", "seq", F.pmod(c("seq") + 1, c("_n")).cast("int").alias("_next"),
        (c("ex") - bx / nb * lin).alias("n2x"), (c("ey") - by / nb * lin).alias("n2y"), (c("ex") + bx / nb * lout).alias("n1x"), (c("ey") + by / nb * lout).alias("n1y"),
    )
    first = j.select("path_id", F.col("_next").alias("seq"), "n1x", "n1y")
    out = segs.join(j.select("path_id", "seq", "n2x", "n2y"), ["path_id", "seq"], "left").join(first, ["path_id", "seq"], "left")
    names = {"c1x": "n1x", "c1y": "n1y", "c2x": "n2x", "c2y": "n2y"}
    return out.select(*[F.coalesce(names[k], k).alias(k) if k in names else F.col(k) for k in segs.columns])


def circle_fit(points: DataFrame, min_points: int = 8) -> DataFrame:
    """Algebraic circle per path from moment sums, with the largest radial residual."""
    c = F.col
    centre = points.groupBy("path_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n")).where(c("n") >= min_points)
    p = points.join(centre, "path_id").select("path_id", "x", "y", "n", "mx", "my", (c("x") - c("mx")).alias("u"), (c("y") - c("my")).alias("v"))
    u, v = c("u"), c("v")
    m = p.groupBy("path_id", "mx", "my", "n").agg(
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"),
        F.sum(u * (u * u + v * v)).alias("uz"), F.sum(v * (u * u + v * v)).alias("vz"),
    )
    det = c("uu") * c("vv") - c("uv") * c("uv")
    m = m.where(F.abs(det) > 1e-9).select(
        "path_id", "mx", "my", "n", ((c("uz") * c("vv") - c("vz") * c("uv")) / det / 2).alias("a"), ((c("vz") * c("uu") - c("uz") * c("uv")) / det / 2).alias("b"), "uu", "vv"
    )
    m = m.select("path_id", (c("mx") + c("a")).alias("cx"), (c("my") + c("b")).alias("cy"), F.sqrt(c("a") * c("a") + c("b") * c("b") + (c("uu") + c("vv")) / c("n")).alias("radius"))
    res = points.join(m, "path_id").groupBy("path_id").agg(F.max(F.abs(F.hypot(c("x") - c("cx"), c("y") - c("cy")) - c("radius"))).alias("residual"))
    return m.join(res, "path_id")


def signed_area(points: DataFrame, block: int | None = None) -> DataFrame:
    """Shoelace area and orientation per path (closing segment included)."""
    df = with_neighbours(points.withColumn("closed", F.lit(True)), 1, block)
    a = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2
    return df.groupBy("path_id").agg(F.when(F.count(F.lit(1)) < 3, 0.0).otherwise(a).alias("signed_area")).withColumn(
        "orientation", F.when(F.col("signed_area") > 0, "positive").when(F.col("signed_area") < 0, "negative").otherwise("degenerate")
    )


def circularity(points: DataFrame, block: int | None = None) -> DataFrame:
    """4*pi*A/P^2, box fill and compactness P^2/(4*pi*A) of the closed outline."""
    ring = segments(points.withColumn("closed", F.lit(True)), block)
    c = F.col
    g = ring.groupBy("path_id").agg(
        F.abs(F.sum(c("x") * c("ny") - c("nx") * c("y")) / 2).alias("area"), F.sum("len").alias("perimeter"),
        ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"),
    )
    four_pi = F.lit(4.0) * F.pi()
    return g.select(
        "path_id", "area", "perimeter", F.when(c("perimeter") > 0, four_pi * c("area") / (c("perimeter") * c("perimeter"))).alias("circularity"),
        F.when(c("box") > 0, c("area") / c("box")).alias("box_fill"), F.when(c("area") > 0, c("perimeter") * c("perimeter") / (four_pi * c("area"))).alias("elongation"),
    )
