"""Job registry, retention, attempt windows, sessions and journals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.functions.columns import codes
from mosaiq.operators.ordered import running_sums
from mosaiq.session import spread

# Terminal states and lifecycle limits.
TERMINAL = ["succeeded", "failed", "cancelled", "damaged"]
CLEANUP_STATES = ["succeeded", "failed", "cancelled", "timed_out", "quarantined"]
LEASE_TTL_SECONDS = 120
FEEDBACK_ISSUES = ["color_deviation", "edge_distortion", "missing_detail", "other"]
ABSOLUTE_GATES = {
    "geometric": (0.98, 0.985, 0.002), "clean_logo": (0.97, 0.98, 0.003),
    "lineart": (0.94, 0.97, 0.004), "photo": (0.75, 0.65, 0.025),
}
ABSOLUTE_DEFAULT = (0.94, 0.95, 0.006)
STAGE_METRICS = ["ssim", "edge_f1", "seam_ratio", "component_delta", "hole_delta"]


def job_state(events: DataFrame) -> DataFrame:
    """Final state per job: the first terminal event wins, else the latest event.

    ``events(job_id, ts, seq, state)``; events after the terminal one are counted.
    """
    at = F.struct("ts", "seq", "state")
    done = F.col("state").isin(TERMINAL)
    g = events.groupBy("job_id").agg(
        F.min(F.when(done, at)).alias("_end"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("events")
    )
    late = (
        events.join(g.where(F.col("_end").isNotNull() & (F.col("_end") < F.col("_last"))).select("job_id", "_end"), "job_id")
        .groupBy("job_id").agg(F.count_if(at > F.col("_end")).alias("rejected"))
    )
    return g.join(late, "job_id", "left").select(
        "job_id", F.coalesce("_end.state", "_last.state").alias("state"), "events",
        F.coalesce("rejected", F.lit(0)).alias("rejected_events"),
    )


def recover_buckets(checked: DataFrame) -> DataFrame:
    """complete / incomplete / damaged per job of rows with state and ``intact``."""
    return checked.withColumn(
        "bucket",
        F.when(~F.coalesce(F.col("intact"), F.lit(False)), "damaged").when(F.col("state").isin(TERMINAL), "complete").otherwise("incomplete"),
    )


def retention_plan(jobs: DataFrame, retention_days: float, user_quota: int, disk_budget: int, now: Column | None = None) -> DataFrame:
    """Victims of expiry, then per-owner quota, then the global budget (oldest first).

    A job goes when the bytes at and after it still exceed the limit, i.e. total
    minus everything older is above it. Running sums go over time ranges, so one
    owner with most of the jobs spreads over many tasks.
    """
    base = jobs.select("job_id", "owner", "bytes", F.col("updated_at").cast("timestamp").alias("_u"))
    if now is None:
        latest = base.agg(F.max("_u").alias("_now"))
        base = base.join(F.broadcast(latest), F.lit(True))  # one row
    else:
        base = base.withColumn("_now", now)
    base = base.withColumn("_t", F.unix_timestamp("_u"))
    expired = F.unix_timestamp("_now") - F.col("_t") > F.lit(retention_days * 86400.0)
    kept, out = base.where(~expired), [base.where(expired).select("job_id", "owner", F.lit("expired").alias("phase"))]
    for phase, keys, limit in (("user_quota", ["owner"], user_quota), ("disk_budget", [], disk_budget)):
        summed = running_sums(kept, keys, ["_t", "job_id"], "bytes", "_older", "_total")
        evict = F.col("_total") - F.col("_older") > limit
        out.append(summed.where(evict).select("job_id", "owner", F.lit(phase).alias("phase")))
        kept = summed.where(~evict).drop("_older", "_total")
    return out[0].unionByName(out[1]).unionByName(out[2])


def accept_remote(local: DataFrame, remote: DataFrame, key: str = "job_id") -> DataFrame:
    """rejected_stale / conflict / accepted per key from revision and digest; one-sided keys are reported."""
    a = local.select(key, F.col("revision").alias("local_revision"), F.col("sha256").alias("_l"))
    b = remote.select(key, F.col("revision").alias("remote_revision"), F.col("sha256").alias("_r"))
    return a.join(b, key, "full_outer").select(
        key, "local_revision", "remote_revision",
        F.when(F.col("remote_revision").isNull(), "no_remote")
        .when(F.col("remote_revision") < F.coalesce("local_revision", F.lit(0)), "rejected_stale")
        .when((F.col("remote_revision") == F.col("local_revision")) & ~F.col("_l").eqNullSafe(F.col("_r")), "conflict")
        .otherwise("accepted").alias("status"),
    )


def attempt_windows(attempts: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decision per attempt inside its fixed window: count so far, allowed, remaining, retry_after.

    The running count goes over time ranges, so a single flooded key, even within one
    second, does not end in one task.
    """
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = attempts.select("event_id", "namespace", "key_id", "ts", t.alias("_t"), (t - t % window_seconds).alias("window_start"), F.lit(1).cast("long").alias("_one"))
    counted = running_sums(rows, ["namespace", "key_id", "window_start"], ["ts", "event_id"], "_one", "_before")
    count = F.col("_before") + 1
    return counted.select(
        "event_id", "namespace", "key_id", "window_start", count.alias("count"),
        (count <= limit).alias("allowed"), F.greatest(F.lit(0), limit - count).alias("remaining"),
        F.greatest(F.lit(1), F.col("window_start") + window_seconds - F.col("_t")).alias("retry_after"),
    )


LEVELS = 40
"""Sizes of session intervals: 1, 2, 4, ... seconds; the last is longer than any range of timestamps in use."""


def dyadic_cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """Array of (level, block): the aligned blocks of 2^level seconds that together are first..last, at most two a level."""
    def at(k: Column) -> Column:
        lo = F.ceil(first / F.pow(F.lit(2.0), k)).cast("long")
        hi = F.floor((last + 1) / F.pow(F.lit(2.0), k)).cast("long")
        # whole blocks of this level lie in lo..hi-1; an even pair belongs to the next level
        left = F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), F.struct(k.alias("level"), lo.alias("block")))
        right = F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1), F.struct(k.alias("level"), (hi - 1).alias("block")))
        return F.array_distinct(F.array_compact(F.array(left, right)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def active_sessions(sessions: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, session_id, user_id) where the session was open at the probe's time.

    Interval join as an equality on (user, level, block): a session is cut into aligned
    blocks of 1, 2, 4, ... seconds, at most two of each size, and a probe asks for the one block around it of each size
    that occurs. However long a session is, it costs a few dozen rows. A session without an end, or that ends
    before it starts, is never open.
    """
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    end = F.least(F.col("expires_at"), F.coalesce("revoked_at", "expires_at"))
    cut = sessions.withColumn("_end", end).where(F.col("created_at") < F.col("_end"))
    cut = cut.select("session_id", "user_id", "created_at", "_end", F.explode(dyadic_cover(sec("created_at"), sec("_end"))).alias("_c"))
    cut = cut.select("session_id", "user_id", "created_at", "_end", "_c.level", "_c.block")
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # at most LEVELS + 1 numbers
    asked = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(sec("ts") / float(1 << k)).cast("long").alias("block")) for k in levels or [0]])
    p = probes.select("probe_id", "user_id", "ts", F.explode(asked).alias("_c")).select("probe_id", "user_id", "ts", "_c.level", "_c.block")
    return cut.join(p, ["user_id", "level", "block"]).where((F.col("created_at") <= F.col("ts")) & (F.col("ts") < F.col("_end"))).select("probe_id", "session_id", "user_id")


def cleanup_candidates(artifacts: DataFrame) -> DataFrame:
    """Terminal, unprotected artifacts, oldest first."""
    protected = F.lit(False)
    for flag in ("active", "pinned", "legal_hold"):
        if flag in artifacts.columns:
            protected = protected | F.coalesce(F.col(flag), F.lit(False))
    return artifacts.where(F.col("state").isin(CLEANUP_STATES) & ~protected).orderBy("updated_at", "job_id")


def stale_leases(leases: DataFrame, ttl_seconds: int = LEASE_TTL_SECONDS) -> DataFrame:
    return leases.where(F.col("lease_age") > ttl_seconds)


def stage_reasons(before: str = "b_", after: str = "a_") -> Column:
    """Reason codes of a mutation stage from prefixed before/after measures.

    Prefixed columns: the STAGE_METRICS, path_count, node_count, byte_size;
    unprefixed image_class.  A null before metric switches to absolute gates.
    """
    b = lambda c: F.col(before + c)
    a = lambda c: F.col(after + c)
    incomplete, known = F.lit(False), F.lit(True)
    for m in STAGE_METRICS:
        incomplete, known = incomplete | a(m).isNull(), known & b(m).isNotNull()
    topo = F.col("image_class") != "photo"
    limit = lambda i: F.coalesce(
        *[F.when(F.col("image_class") == k, F.lit(v[i])) for k, v in ABSOLUTE_GATES.items()], F.lit(ABSOLUTE_DEFAULT[i])
    )
    n = lambda c: F.greatest(F.lit(1), F.coalesce(b(c), F.lit(0)))
    grown = lambda c, times, extra: F.coalesce(a(c), F.lit(0)) > F.greatest(n(c) * times, n(c) + extra)
    measured = codes(
        ("topology_component_regression", topo & F.when(known, a("component_delta") > b("component_delta")).otherwise(a("component_delta") > 0)),
        ("topology_hole_regression", topo & F.when(known, a("hole_delta") > b("hole_delta")).otherwise(a("hole_delta") > 0)),
        ("ssim_regression", known & (a("ssim") < b("ssim") - 0.0005)),
        ("edge_f1_regression", known & (a("edge_f1") < b("edge_f1") - 0.0015)),
        ("seam_regression", known & (a("seam_ratio") > F.greatest(b("seam_ratio") + 0.0005, b("seam_ratio") * 1.25))),
        ("ssim_absolute_gate", ~known & (a("ssim") < limit(0))),
        ("edge_f1_absolute_gate", ~known & (a("edge_f1") < limit(1))),
        ("seam_absolute_gate", ~known & (a("seam_ratio") > limit(2))),
        ("path_complexity_explosion", grown("path_count", 4, 500)),
        ("node_complexity_explosion", grown("node_count", 4, 2500)),
        ("byte_complexity_explosion", grown("byte_size", 3, 250000)),
    )
    return F.when(incomplete, F.array(F.lit("stage_metrics_incomplete"))).otherwise(measured)


def stage_gate(pairs: DataFrame) -> DataFrame:
    """Adds reason codes and ``accepted`` to rows with b_/a_ measures."""
    return pairs.withColumn("reasons", stage_reasons()).withColumn("accepted", F.size("reasons") == 0)


def measured_apply(before: DataFrame, transform: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Apply a user transform to measured rows and keep it only where the stage gate passes.

    Rows whose gate fails keep their previous measures (rollback); the reasons
    are returned in ``reasons``.
    """
    names = [*STAGE_METRICS, "path_count", "node_count", "byte_size"]
    b = before.select(key, "image_class", *[F.col(c).alias(f"b_{c}") for c in names])
    a = transform(before).select(key, *[F.col(c).alias(f"a_{c}") for c in names])
    gated = stage_gate(b.join(a, key, "left"))
    return gated.select(
        key, "image_class", *[F.when(F.col("accepted"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in names],
        "accepted", "reasons",
    )


def verify_chain(stages: DataFrame, journal: str = "journal_id", baselines: DataFrame | None = None) -> DataFrame:
    """(journal, stage, code) where a stage's parent is not the previous accepted digest.

    ``stages(journal, stage 1..n, parent_sha256, accepted_sha256)``.  Optional
    ``baselines(journal, baseline_sha256, final_sha256)`` also checks both ends.
    Neighbouring stages meet by an equality join, not a per-journal window.
    """
    prev = stages.select(journal, (F.col("stage") + 1).alias("stage"), F.col("accepted_sha256").alias("_prev"))
    # dealt by a given number: digests hardly compress, and merged partitions are sorted in full width
    linked = spread(stages, journal, "stage").join(spread(prev, journal, "stage"), [journal, "stage"])
    bad = linked.where(F.col("_prev").isNotNull() & ~F.col("parent_sha256").eqNullSafe(F.col("_prev")))
    out = bad.select(journal, "stage", F.lit("stage_parent_hash_mismatch").alias("code"))
    if baselines is not None:
        first = spread(stages.where("stage = 1"), journal).join(spread(baselines, journal), journal).where(~F.col("parent_sha256").eqNullSafe(F.col("baseline_sha256")))
        last = spread(stages, journal).groupBy(journal).agg(F.max_by("accepted_sha256", "stage").alias("_fin"), F.max("stage").alias("stage")).join(spread(baselines, journal), journal)
        out = out.unionByName(first.select(journal, "stage", F.lit("journal_boundary_hash_mismatch").alias("code")))
        out = out.unionByName(
            last.where(~F.col("_fin").eqNullSafe(F.col("final_sha256"))).select(journal, "stage", F.lit("journal_final_hash_mismatch").alias("code"))
        )
    return out


FEEDBACK_SCHEMA = (
    "job_id string, issue_type string, coordinate_x double, coordinate_y double, user_comment string, "
    "expected_color_hex string, actual_color_hex string"
)


def hex_distance(a: str, b: str) -> Column:
    """RGB distance of two #rrggbb colours times 0.1; null unless both parse."""
    channel = lambda c, i: F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")
    ok = F.col(a).rlike("^#[0-9a-fA-F]{6}$") & F.col(b).rlike("^#[0-9a-fA-F]{6}$")
    total = sum((F.pow(channel(a, i) - channel(b, i), 2) for i in range(3)), F.lit(0.0))
    return F.when(ok, F.sqrt(total) * 0.1)


def feedback_cases(parsed: DataFrame) -> DataFrame:
    """Validated feedback with reject reason (null = accepted) and colour distance."""
    bad_hex = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike("^#[0-9a-fA-F]{6}$")
    reason = (
        F.when(~F.coalesce(F.col("job_id").rlike("^[a-zA-Z0-9]{32}$"), F.lit(False)), "invalid_job_id")
        .when(~F.coalesce(F.col("issue_type").isin(FEEDBACK_ISSUES), F.lit(False)), "invalid_issue_type")
        .when(bad_hex("expected_color_hex") | bad_hex("actual_color_hex"), "invalid_color")
    )
    return parsed.withColumn("reject_reason", reason).withColumn(
        "delta_e_estimation", F.when(reason.isNull(), hex_distance("expected_color_hex", "actual_color_hex"))
    )


def feedback_rollup(cases: DataFrame) -> DataFrame:
    """Counts and mean distance per issue and job, per issue, and overall."""
    return cases.where("reject_reason is null").rollup("issue_type", "job_id").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("delta_e_estimation").alias("mean_delta_e")
    )


def admin_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest jobs first; the limit is the size of the listing."""
    return jobs.orderBy(F.col("updated_at").desc(), F.col("job_id").desc()).limit(limit)
