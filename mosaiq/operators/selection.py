"""Candidate ranking and selection per job.

Candidates: job_id, name, ord (input position, 1-based), engine, fidelity,
edge_f1, path_count, total_score, rendered_ok.  Winners are picked by
``max_by`` aggregates, which combine before the shuffle, so one job holding
most candidates does not overload a task.  Equal keys keep the lowest ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.columns import codes
from mosaiq.operators.ordered import running_sums
from mosaiq.session import cut_lineage

# Selection margins and preference orders.
NEAR_MARGIN = 2.0
NEAR_PREFERENCE = ["logo_standard", "minimal_standard", "lineart_clean", "single_clean", "photo_standard"]
GEOMETRIC_MARGIN = 4.0
GEOMETRIC_PREFERENCE = ["geo_standard", "geo_detail", "geo_mixed", "geo_clean", "geo_contour"]
EDIT_MARGIN, EDIT_LEAN_RATIO, EDIT_EDGE_TOL, QUALITY_FLOOR = 2.5, 0.5, 0.03, 78.0
SHADOW_MARGIN, SHADOW_EDGE_TOL, SHADOW_PATH_RATIO = 1.5, 0.02, 0.70
MAX_CANDIDATES = 12
FIDELITY_LED_MODES = ["logo_color", "photo_poster"]


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def fidelity_key() -> Column:
    """Fidelity to one decimal, then fewer paths, then total score, then input order."""
    return F.struct(
        F.bround(F.coalesce(F.col("fidelity"), F.lit(0.0)), 1), -zero("path_count"),
        F.coalesce(F.col("total_score"), F.lit(0.0)), -F.col("ord"),
    )


def rendered() -> Column:
    return F.coalesce(F.col("rendered_ok"), F.lit(False)) & F.col("fidelity").isNotNull()


def rank_candidates(cand: DataFrame) -> DataFrame:
    """Most faithful rendered candidate per job (bitmap candidates excluded when flagged)."""
    ok = rendered()
    if "has_bitmap" in cand.columns:
        ok = ok & ~F.coalesce(F.col("has_bitmap"), F.lit(False))
    return cand.where(ok).groupBy("job_id").agg(
        F.max_by("name", fidelity_key()).alias("chosen"), F.count(F.lit(1)).alias("rendered")
    )


def near_score_preference(
    cand: DataFrame, preference: list[str] = NEAR_PREFERENCE, margin: float = NEAR_MARGIN
) -> DataFrame:
    """Best total score, unless a preferred name lies within ``margin``.

    One aggregation: the best score and the score of each preferred name.
    """
    named = [F.max(F.when(F.col("name") == p, F.col("total_score"))).alias(f"_p{i}") for i, p in enumerate(preference)]
    g = cand.groupBy("job_id").agg(
        F.max("total_score").alias("_best"),
        F.max_by("name", F.struct("total_score", -F.col("ord"))).alias("raw_best"),
        *named,
    )
    near = F.coalesce(
        *[F.when(F.col("_best") - F.col(f"_p{i}") <= margin, F.lit(p)) for i, p in enumerate(preference)], F.col("raw_best")
    )
    return g.select(
        "job_id", "raw_best", near.alias("chosen"),
        F.when(near == F.col("raw_best"), "highest_total_score").otherwise("near_score_preference").alias("reason"),
    )


def geometric_selection(cand: DataFrame, preference: list[str] = GEOMETRIC_PREFERENCE, clean: str = "geo_clean") -> DataFrame:
    """Viability filter, preference within the margin, corner rule, fidelity guard.

    Extra columns: unique_colors, geometry_score, corner_score, axis_score, straight_score.
    """
    tops = cand.groupBy("job_id").agg(F.max("unique_colors").alias("_mc"), F.max("path_count").alias("_mp"))
    ok = (F.col("unique_colors") >= F.col("_mc")) & (F.col("path_count") >= F.greatest(F.lit(1), F.floor(F.lit(0.4) * F.col("_mp"))))
    row = F.struct(
        "name", "total_score", F.when(rendered(), F.col("fidelity")).alias("fid"),
        F.coalesce("geometry_score", F.lit(0.0)).alias("geo"), F.coalesce("corner_score", F.lit(0.0)).alias("corner"),
        F.coalesce("axis_score", F.lit(0.0)).alias("axis"), F.coalesce("straight_score", F.lit(0.0)).alias("straight"),
    )
    # one row per (job, viable); jobs without a viable candidate fall back to all of theirs
    g = (
        cand.join(tops, "job_id").withColumn("_ok", ok)
        .groupBy("job_id", "_ok")
        .agg(
            F.max_by(row, F.struct("total_score", -F.col("ord"))).alias("raw"),
            F.max_by(row, F.when(rendered(), F.struct("fidelity", -F.col("ord")))).alias("top"),
            *[F.max_by(row, F.when(F.col("name") == p, F.col("ord"))).alias(f"p{i}") for i, p in enumerate(preference)],
        )
        .groupBy("job_id")
        .agg(F.max_by(F.struct("raw", "top", *[f"p{i}" for i in range(len(preference))]), "_ok").alias("s"))
        .select("job_id", "s.*")
    )
    near = lambda c: F.col("raw.total_score") - F.col(f"{c}.total_score") <= GEOMETRIC_MARGIN
    g = g.withColumn("c1", F.coalesce(*[F.when(near(f"p{i}"), F.col(f"p{i}")) for i in range(len(preference))], F.col("raw")))
    cl = f"p{preference.index(clean)}"
    corner = (
        near(cl) & (F.col(f"{cl}.name") != F.col("c1.name"))
        & (F.col(f"{cl}.corner") >= F.col("c1.corner") + 8) & (F.col(f"{cl}.axis") >= F.col("c1.axis") + 8)
        & (F.col(f"{cl}.straight") >= F.col("c1.straight"))
    )
    corner = F.coalesce(corner, F.lit(False))
    g = g.withColumn("_corner", corner).withColumn("c2", F.when(F.col("_corner"), F.col(cl)).otherwise(F.col("c1")))
    guard = (
        (F.col("top.name") != F.col("c2.name")) & (F.col("top.fid") > F.col("c2.fid") + 1.5)
        & (F.col("top.geo") >= F.col("c2.geo") - 5.0) & (F.col("top.corner") >= F.col("c2.corner") - 5.0)
    )
    guard = F.coalesce(guard, F.lit(False))
    return g.select(
        "job_id", F.col("raw.name").alias("raw_best"),
        F.when(guard, F.col("top.name")).otherwise(F.col("c2.name")).alias("chosen"),
        F.when(guard, "fidelity_guard").when(F.col("_corner"), "corner_cleanliness_preference")
        .when(F.col("c1.name") == F.col("raw.name"), "highest_total_score")
        .otherwise("near_score_geometric_preference").alias("reason"),
    )


def select_best(cand: DataFrame, preference: list[str] = NEAR_PREFERENCE) -> DataFrame:
    """Selection per job by its mode: fidelity-led, geometric, or near-score."""
    led = F.col("mode").isin(FIDELITY_LED_MODES)
    fid = rank_candidates(cand.where(led)).select("job_id", F.col("chosen").alias("_fid"))
    near = near_score_preference(cand.where(F.col("mode") != "geometric_logo"), preference).join(fid, "job_id", "left").select(
        "job_id", "raw_best", F.coalesce("_fid", "chosen").alias("chosen"),
        F.when(F.col("_fid").isNotNull(), "highest_fidelity").otherwise(F.col("reason")).alias("reason"),
    )
    return near.unionByName(geometric_selection(cand.where(F.col("mode") == "geometric_logo")))


def editability_preference(cand: DataFrame) -> DataFrame:
    """Leanest candidate inside the fidelity/edge envelope, if at most half the paths."""
    live = cand.where(rendered())
    top = live.groupBy("job_id").agg(
        F.max_by(F.struct("name", "fidelity", F.coalesce("edge_f1", F.lit(0.0)).alias("edge"), zero("path_count").alias("paths")), fidelity_key()).alias("top")
    )
    floor = F.col("top.fidelity") - EDIT_MARGIN
    floor = F.when(F.col("top.fidelity") >= QUALITY_FLOOR, F.greatest(floor, F.lit(QUALITY_FLOOR))).otherwise(floor)
    near = live.join(top, "job_id").where(
        (F.col("fidelity") >= floor) & (F.coalesce("edge_f1", F.lit(0.0)) >= F.col("top.edge") - EDIT_EDGE_TOL)
    )
    g = near.groupBy("job_id").agg(
        F.min_by(F.struct("name", zero("path_count").alias("paths")), F.struct(zero("path_count"), "ord")).alias("lean"),
        F.first("top").alias("top"),
    )
    take = (F.col("lean.name") != F.col("top.name")) & (
        F.col("lean.paths") <= F.lit(EDIT_LEAN_RATIO) * F.greatest(F.lit(1), F.col("top.paths"))
    )
    return g.select(
        "job_id",
        F.when(take, F.col("lean.name")).otherwise(F.col("top.name")).alias("chosen"),
        F.when(take, "editability_preference").otherwise("highest_fidelity").alias("reason"),
    )


def family(engine: str = "engine", name: str = "name") -> Column:
    return (
        F.when(F.col(engine) == "gradient", "gradient")
        .when(F.col(name).contains("center") | (F.col(engine) == "autotrace"), "centerline")
        .when(F.col(name).contains("contour"), "contour")
        .when(F.col(engine) == "vtracer", "region")
        .otherwise(F.coalesce(F.nullif(F.col(engine), F.lit("")), F.lit("unknown")))
    )


def normalize_candidates(cand: DataFrame) -> DataFrame:
    """Typed hypothesis rows with defaults, family and sorted code arrays.

    ``hypothesis_family``, ``hard_fail_codes`` and ``unmeasured_required`` are optional.
    """
    cols = cand.columns
    arr = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))) if c in cols else F.array().cast("array<string>")
    explicit = F.nullif(F.col("hypothesis_family"), F.lit("")) if "hypothesis_family" in cols else F.lit(None)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return cand.select(
        "job_id", "ord", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("candidate")).alias("name"),
        F.coalesce(explicit, family()).alias("family"),
        num("fidelity"), num("total_score"), num("edge_f1"),
        F.greatest(F.lit(0), zero("path_count")).alias("path_count"),
        F.coalesce("rendered_ok", F.lit(False)).alias("rendered_ok"),
        arr("hard_fail_codes").alias("hard_fail_codes"), arr("unmeasured_required").alias("unmeasured_required"),
    )


def reject_reasons(views: DataFrame, floor: float = QUALITY_FLOOR, max_candidates: int | None = None) -> DataFrame:
    """Adds ``reasons`` (empty = eligible); with ``max_candidates`` only to the first so many by input position ``ord``."""
    reasons = F.concat(
        codes(("render_failed", ~F.col("rendered_ok")), ("fidelity_below_floor", F.col("fidelity") < floor)),
        F.col("hard_fail_codes"),
        F.transform("unmeasured_required", lambda c: F.concat(F.lit("unmeasured:"), c)),
    )
    if max_candidates is not None:
        views = views.where(F.col("ord") <= max_candidates)
    return views.withColumn("reasons", reasons)


def eligible(views: DataFrame) -> DataFrame:
    return reject_reasons(views).where(F.size("reasons") == 0)


def shadow_key() -> Column:
    return F.struct(
        F.bround("fidelity", 4), F.bround("edge_f1", 5), -F.col("path_count"), F.bround("total_score", 4), F.col("name")
    )


STEP_ROWS = 512
"""Candidates compared with each other at once by the frontier sweep."""
JOB_ROWS = 100_000
"""Distinct measures of a job that one task settles; a larger job is cut into slices of so many."""
_MEASURES = ["fidelity", "edge_f1", "path_count"]


class _Stairs:
    """Fewest paths seen at each edge score or above: both ascend."""

    def __init__(self) -> None:
        self.edge, self.paths = np.zeros(0), np.zeros(0)

    def add(self, edge: np.ndarray, paths: np.ndarray) -> None:
        edge, paths = np.concatenate([self.edge, edge]), np.concatenate([self.paths, paths])
        order = np.lexsort((paths, -edge))
        edge, paths = edge[order], paths[order]
        step = np.ones(len(paths), dtype=bool)
        step[1:] = paths[1:] < np.minimum.accumulate(paths)[:-1]
        self.edge, self.paths = edge[step][::-1], paths[step][::-1]

    def covers(self, edge: np.ndarray, paths: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edge, edge)
        inside = at < len(self.edge)
        out = np.zeros(len(edge), dtype=bool)
        out[inside] = self.paths[at[inside]] <= paths[inside]
        return out


def _undominated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct measures that no other of their job dominates (fidelity up, edge up, paths down), jobs together.

    In the order of falling fidelity and edge score only an earlier row can dominate a later one. Rows are compared
    inside a step at once and with the stairs of the steps before.
    """
    pdf = pdf.drop_duplicates()
    job = pd.factorize(pdf["job_id"])[0]
    f, e, p = (pdf[c].to_numpy(dtype=float) for c in _MEASURES)
    order = np.lexsort((p, -e, -f, job))
    job, e, p = job[order], e[order], p[order]
    keep, stairs, of = np.ones(len(order), dtype=bool), _Stairs(), -1
    for a in range(0, len(order), STEP_ROWS):
        s = slice(a, a + STEP_ROWS)
        earlier = np.tri(len(job[s]), k=-1, dtype=bool)
        beaten = (earlier & (job[s] == job[s][:, None]) & (e[s] >= e[s][:, None]) & (p[s] <= p[s][:, None])).any(axis=1)
        beaten |= (job[s] == of) & stairs.covers(e[s], p[s])
        keep[s] = ~beaten
        if job[s][-1] != of:
            stairs, of = _Stairs(), job[s][-1]
        new = keep[s] & (job[s] == of)
        stairs.add(e[s][new], p[s][new])
    return pdf.iloc[np.sort(order[keep])]


def _prune_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield _undominated(pdf)


def _prune_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact frontiers of a partition sorted by job: carry the open job between batches."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = _undominated(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
        open_job = pdf["job_id"].iloc[-1]
        held = pdf[pdf["job_id"] == open_job]
        done = pdf[pdf["job_id"] != open_job]
        if len(done):
            yield done
    if held is not None:
        yield held


def _beaten_by_earlier(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that ask and are dominated by one of the rows before them in the order of the job."""
    before = pdf["asks"].to_numpy() == 0
    e, p = pdf["edge_f1"].to_numpy(dtype=float), pdf["path_count"].to_numpy(dtype=float)
    stairs = _Stairs()
    stairs.add(e[before], p[before])
    return pdf[~before & stairs.covers(e, p)][["job_id", *_MEASURES]]


def _sliced_frontier(measures: DataFrame, slice_rows: int) -> DataFrame:
    """Frontiers of large jobs: slices in the order of falling fidelity, each held against all slices before it.

    The slices before one are the union of at most one aligned run of 1, 2, 4, ... slices each, so a row asks
    a few runs only, and all runs of a job are looked at by different tasks.
    """
    schema = measures.schema
    order = [F.desc("fidelity"), F.desc("edge_f1"), "path_count"]
    placed = running_sums(measures.withColumn("_one", F.lit(1).cast("long")), ["job_id"], order, "_one", "_pos")
    keys = [F.col("job_id"), F.floor(F.col("_pos") / slice_rows).cast("int").alias("slice")]
    local = placed.select("*", keys[1]).groupBy("job_id", "slice").applyInPandas(
        lambda key, pdf: _undominated(pdf[["job_id", *_MEASURES]]).assign(slice=key[1]), f"{measures._jdf.schema().toDDL()}, slice int")
    local = cut_lineage(local)
    levels = int(local.agg(F.max("slice")).first()[0] or 0).bit_length()
    run = lambda k: F.shiftright("slice", k)
    odd = lambda k: run(k) % 2 == 1
    at = F.array_compact(F.array(*[F.struct(F.lit(k).alias("level"), F.when(odd(k), run(k) - 1).otherwise(run(k)).alias("run"), F.when(odd(k), 1).otherwise(0).alias("asks")) for k in range(levels)]))
    if not levels:
        return local.select(*measures.columns)
    asked = local.withColumn("_at", F.explode(at)).select(*measures.columns, "_at.*")
    beaten = asked.groupBy("job_id", "level", "run").applyInPandas(_beaten_by_earlier, schema).distinct()
    return local.select(*measures.columns).join(beaten, measures.columns, "left_anti")


def pareto_frontier(views: DataFrame, job_rows: int = JOB_ROWS) -> DataFrame:
    """(job_id, name) not dominated within their job. A candidate without all three measures neither dominates nor is dominated.

    Each task first drops what is dominated inside its own batches, so only distinct measures of
    local frontiers are shuffled. Jobs of up to ``job_rows`` of these are settled by one task each, larger ones slice by slice.
    """
    rows = views.select("job_id", "name", F.col("fidelity").cast("double"), F.col("edge_f1").cast("double"), F.col("path_count").cast("bigint"))
    measured = F.lit(True)
    for c in _MEASURES:
        measured = measured & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    whole = rows.where(measured & F.col("job_id").isNotNull())
    measures = whole.select("job_id", *_MEASURES)
    local = cut_lineage(measures.mapInPandas(_prune_batches, measures.schema))
    large = local.groupBy("job_id").count().where(F.col("count") > job_rows).select("job_id")
    large = cut_lineage(large)
    split = not large.isEmpty()
    small = local.join(large, "job_id", "left_anti") if split else local
    best = small.repartition("job_id").sortWithinPartitions("job_id").mapInPandas(_prune_sorted, measures.schema)
    if split:
        best = best.unionByName(_sliced_frontier(local.join(large, "job_id", "left_semi").distinct(), job_rows))
    kept = whole.join(best, measures.columns, "left_semi")
    return kept.select("job_id", "name").unionByName(rows.where(~measured | F.col("job_id").isNull()).select("job_id", "name"))


def safe_simpler_winner(elig: DataFrame) -> DataFrame:
    """Top hypothesis, or a materially simpler one inside the safe envelope."""
    top = elig.groupBy("job_id").agg(F.max_by(F.struct("name", "fidelity", "edge_f1", "path_count"), shadow_key()).alias("top"))
    near = (F.col("fidelity") >= F.greatest(F.lit(QUALITY_FLOOR), F.col("top.fidelity") - SHADOW_MARGIN)) & (
        F.col("edge_f1") >= F.col("top.edge_f1") - SHADOW_EDGE_TOL
    )
    simple = near & (F.col("path_count") <= F.greatest(F.lit(1), F.floor(F.col("top.path_count") * F.lit(SHADOW_PATH_RATIO))))
    key = F.struct(-F.col("path_count"), "fidelity", "edge_f1", "total_score", "name")
    g = elig.join(top, "job_id").groupBy("job_id").agg(
        F.max_by("name", F.when(simple, key)).alias("lean"), F.first("top").alias("top")
    )
    winner = F.coalesce("lean", "top.name")
    return g.select(
        "job_id", winner.alias("winner"),
        F.when(winner != F.col("top.name"), "safe_editability_preference").otherwise("highest_quality").alias("reason"),
    )


def family_best(elig: DataFrame) -> DataFrame:
    return elig.groupBy("job_id", "family").agg(F.max_by("name", shadow_key()).alias("name"))


def shadow_compare(production: DataFrame, shadow: DataFrame) -> DataFrame:
    """production(job_id, production) vs shadow(job_id, winner) -> decision per job."""
    both = production.join(shadow.select("job_id", "winner"), "job_id", "full_outer")
    same = F.col("production") == F.col("winner")
    return both.select(
        "job_id", "production", F.col("winner").alias("shadow"),
        F.when(same, "agreement").when(F.col("winner").isNull(), "shadow_no_winner").otherwise("disagreement").alias("decision"),
    )


def best_refined(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Best of the base winner and its rendered variants; the base wins ties."""
    pool = base.withColumn("ord", F.lit(0)).withColumn("_base", F.lit(True)).unionByName(
        variants.where(rendered()).withColumn("_base", F.lit(False)), allowMissingColumns=True
    )
    g = pool.groupBy("job_id").agg(
        F.max(F.when(F.col("_base"), F.struct("name", F.coalesce("fidelity", F.lit(0.0)).alias("f"), "rendered_ok"))).alias("b"),
        F.max_by(F.struct("name", F.coalesce("fidelity", F.lit(0.0)).alias("f"), "_base"), fidelity_key()).alias("w"),
    ).where(F.col("b").isNotNull())
    skip = ~F.coalesce(F.col("b.rendered_ok"), F.lit(False)) | (F.col("b.f") >= 99.0)
    win = F.when(skip, F.struct(F.col("b.name"), F.col("b.f"), F.lit(True).alias("_base"))).otherwise(F.col("w"))
    return g.select(
        "job_id", win["name"].alias("winner"), (~win["_base"]).alias("applied"),
        F.bround("b.f", 2).alias("base_fidelity"), F.bround(win["f"], 2).alias("refined_fidelity"),
    )


def candidate_report(attempted: DataFrame, scored: DataFrame) -> DataFrame:
    """All attempted candidates with their scored row if any, plus late variants."""
    a = attempted.select("job_id", "name", F.lit(True).alias("_a"))
    s = scored.select("job_id", "name", "fidelity", "total_score", F.lit(True).alias("_s"))
    return a.join(s, ["job_id", "name"], "full_outer").select(
        "job_id", "name", "fidelity", "total_score",
        F.when(F.col("_a").isNull(), "late_variant").when(F.col("_s").isNull(), "failed").otherwise("scored").alias("state"),
    )

