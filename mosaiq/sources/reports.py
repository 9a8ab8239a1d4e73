"""JSON report sources and sinks: tolerant logs, nested reports, shards, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mosaiq.operators.evidence import METRICS
from mosaiq.operators.jobs import FEEDBACK_SCHEMA
from mosaiq.operators.ordered import running_sums

BENCH_SCHEMA = "benchmark-results-v1"
REPORT_SCHEMA = """job_id string, user string, mode_used string,
 quality_report struct<status:string,warnings:array<string>,metrics:struct<fidelity_score:double>>,
 candidate_report struct<best_candidate:string,best_score:double,selection_reason:string,candidates:array<struct<name:string,fidelity_score:double>>>"""


def parse_feedback(lines: DataFrame, column: str = "line", schema: str = FEEDBACK_SCHEMA) -> DataFrame:
    """Parse JSON lines; blank and corrupt lines are dropped, other columns kept."""
    parsed = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    keep = [c for c in lines.columns if c != column]
    return (
        lines.where(F.trim(column) != "").withColumn("_p", parsed)
        .where(F.col("_p").isNotNull() & F.col("_p._corrupt").isNull())
        .select(*keep, "_p.*").drop("_corrupt")
    )


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_feedback(spark.read.text(path).withColumnRenamed("value", "line"))


def flatten_job_reports(df: DataFrame, column: str = "report") -> DataFrame:
    """One row per nested job report; fidelity falls back from quality metrics to the best candidate."""
    r = df.select(F.from_json(column, REPORT_SCHEMA).alias("r")).where(F.col("r.job_id").isNotNull())
    best = F.filter("r.candidate_report.candidates", lambda c: c["name"] == F.col("r.candidate_report.best_candidate"))
    # zero and null both count as "absent" in the fallback chain
    truthy = lambda c: F.nullif(c, F.lit(0.0))
    fid = F.coalesce(
        truthy(F.col("r.quality_report.metrics.fidelity_score")), truthy(F.col("r.candidate_report.best_score")),
        F.get(best, F.lit(0))["fidelity_score"],
    )
    return r.select(
        "r.job_id", "r.user", "r.mode_used", F.col("r.quality_report.status").alias("status"), fid.alias("fidelity"),
        F.col("r.candidate_report.best_candidate").alias("best_candidate"),
        F.coalesce(F.size("r.quality_report.warnings"), F.lit(0)).alias("warning_count"),
    )


def parse_bench_results(df: DataFrame, column: str = "value") -> DataFrame:
    """Long (case_id, metric, value, error) from result payloads; nulls are kept.

    A payload with another schema version yields one row with ``error`` set.
    """
    schema = f"schema_version string, results array<struct<case_id:string,engine_version:string,artifact_sha256:string,failure:string,metrics:map<string,double>>>"
    p = df.select(F.from_json(column, schema).alias("p"))
    ok = F.coalesce(F.col("p.schema_version") == BENCH_SCHEMA, F.lit(False))
    good = p.where(ok).select(F.explode("p.results").alias("r")).select(
        F.col("r.case_id").alias("case_id"), F.explode(F.array(*map(F.lit, METRICS))).alias("metric"), F.col("r.metrics").alias("_m")
    )
    good = good.select("case_id", "metric", F.col("_m")[F.col("metric")].alias("value"), F.lit(None).cast("string").alias("error"))
    bad = p.where(~ok).select(
        F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("string").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.lit("unsupported_schema").alias("error"),
    )
    return good.unionByName(bad)


def read_bench_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_bench_results(spark.read.text(path, wholetext=True))


def first_present(column: str, paths: list[str]) -> Column:
    """First non-null value among ordered JSON paths."""
    return F.coalesce(*[F.get_json_object(column, p) for p in paths])


def union_shards(shards: list[DataFrame]) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def check_shards(results: DataFrame, expected: DataFrame, shard_count: int) -> DataFrame:
    """(case_id, code): duplicate, missing, unexpected, or in the wrong shard.

    The shard of a case is its position in case order modulo ``shard_count``;
    positions come from a sliced prefix sum, not a global window.
    """
    cases = expected.select("case_id").distinct().withColumn("_one", F.lit(1))
    placed = running_sums(cases, [], ["case_id"], "_one", "_pos").select(
        "case_id", F.pmod("_pos", F.lit(shard_count)).cast("int").alias("_want")
    )
    seen = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), F.min("shard").alias("_lo"), F.max("shard").alias("_hi"))
    j = placed.join(seen, "case_id", "full_outer")
    code = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), "missing_case"),
            F.when(F.col("_want").isNull(), "unexpected_case"),
            F.when(F.col("_n") > 1, "duplicate_case"),
            F.when((F.col("_lo") != F.col("_want")) | (F.col("_hi") != F.col("_want")), "wrong_shard"),
        )
    )
    return j.select("case_id", F.explode(code).alias("code"))


def payload_digest(fields: list[str]) -> Column:
    """sha256 of the canonical JSON of ``fields`` (sorted keys, nulls kept)."""
    return F.sha2(canonical_json(fields), 256)


def canonical_json(fields: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def with_envelope(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return df.select(key, canonical_json(fields).alias("payload"), payload_digest(fields).alias("sha256"))


def write_checked(df: DataFrame, path: str, key: str, fields: list[str]) -> None:
    """Write payload + digest rows."""
    with_envelope(df, key, fields).write.mode("append").parquet(path)


def check_envelope(df: DataFrame) -> DataFrame:
    return df.withColumn("intact", F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False)))


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(intact rows, damaged rows for quarantine)."""
    checked = check_envelope(spark.read.parquet(path))
    return checked.where("intact"), checked.where("not intact")


def new_objects(df: DataFrame, existing: DataFrame, digest: str = "source_sha256", object_prefix: str = "objects/") -> DataFrame:
    """Rows whose digest is not stored yet, one per digest, with their object id.

    The kept row of a digest is the one with the smallest case_id.
    """
    fresh = df.join(existing.select(digest).distinct(), digest, "left_anti")
    one = fresh.groupBy(digest).agg(F.min("case_id").alias("case_id"), F.min_by("source_format", "case_id").alias("source_format"))
    prefix = F.substring(digest, 1, 2)
    return one.select(
        "case_id", digest, prefix.alias("prefix"),
        F.concat(F.lit(object_prefix), prefix, F.lit("/"), F.col(digest), F.lit("."), "source_format").alias("object_id"),
    )


def write_content_addressed(df: DataFrame, path: str, digest: str = "source_sha256") -> None:
    """Append unseen objects under prefix directories; stored digests are never rewritten."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001 - only a missing store is acceptable
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        existing = df.limit(0)
    new_objects(df, existing, digest).write.mode("append").partitionBy("prefix").parquet(path)


def telemetry_lines(df: DataFrame) -> DataFrame:
    """One deterministic JSON line per row (sorted keys, nulls kept)."""
    return df.select(canonical_json(df.columns).alias("value"))


def append_telemetry(df: DataFrame, path: str) -> None:
    telemetry_lines(df).write.mode("append").text(path)


def export_report(df: DataFrame, path: str) -> None:
    """Write a summary as JSON rows, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
