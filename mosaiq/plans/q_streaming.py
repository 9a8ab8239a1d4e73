"""Streaming operators as queries: the same functions run to completion over a table.

Each reads its table as a bounded stream and lands in a memory table; the batch
operators are the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mosaiq.functions.columns import rounded
from mosaiq.plans.registry import Tables, query, scratch
from mosaiq.streaming import streams


FILES = 4
"""Files of a micro-batch, each read by a task of its own."""


def _as_stream(t: Tables, df: DataFrame, name: str, time: str = "ts", parts: int = 3) -> DataFrame:
    """``df`` as files in the order of time, FILES of them a micro-batch; cuts fall inside windows and jobs."""
    path = scratch(t, name)
    at = F.col(time).cast("double")
    cuts = df.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)]).alias("c")).first()["c"] or []
    piece = reduce(lambda n, c: n + (at > c).cast("int"), cuts, F.lit(0))
    for k in range(parts):
        df.where(piece == k).repartition(FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _finish(t: Tables, out: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``out`` to its end; of rows with equal ``keys`` the last batch's stays."""
    path, ckpt = scratch(t, "out"), scratch(t, "ckpt")

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    q = out.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    landed = t.spark.read.schema(StructType([*out.schema.fields, StructField("b", LongType())])).parquet(path)
    if not keys:
        return landed.drop("b")
    rest = [c for c in out.columns if c not in keys]
    return landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "b").alias("_last")).select(*keys, "_last.*").select(*out.columns)


@query("stream_attempts", """SELECT CAST(FLOOR(epoch(ts)/86400) AS BIGINT)*86400 AS window_start, namespace, key_id, COUNT(*) AS count, COUNT(*)<=2 AS allowed, GREATEST(0, 2-COUNT(*)) AS remaining FROM attempt GROUP BY 1,2,3""")
def _(t: Tables):
    a = t("attempt").select(F.col("ts").cast("timestamp").alias("ts"), "namespace", "key_id")
    return _finish(t, streams.stream_attempts(_as_stream(t, a, "attempts"), 2, 86400), "update", ("window_start", "namespace", "key_id"))


@query("stream_dedupe", "SELECT DISTINCT source_sha256 FROM case_rec")
def _(t: Tables):
    # ten hours of arrivals, within the lateness: copies of a case meet across micro-batches
    c = t("case_rec").select("source_sha256", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("case_id") * 37 % 600).cast("int"))).alias("ts"))
    return _finish(t, streams.stream_dedupe(_as_stream(t, c, "cases"), "source_sha256"), "append").select("source_sha256")


@query("stream_agreement", """WITH c AS (SELECT o_orderdate AS ts, o_orderkey%3=0 AS ag FROM orders) SELECT CAST(FLOOR(epoch(ts)/86400) AS BIGINT)*86400 AS window_start, COUNT(*) AS jobs, COUNT(*) FILTER (ag) AS agreements, round(COUNT(*) FILTER (ag)/COUNT(*),6) AS agreement_rate FROM c GROUP BY 1""")
def _(t: Tables):
    d = t("orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.expr("CASE WHEN o_orderkey%3=0 THEN 'agreement' ELSE 'disagreement' END").alias("decision"))
    return rounded(_finish(t, streams.stream_agreement(_as_stream(t, d, "decisions")), "update", ("window_start",)))


@query("stream_feedback", """SELECT line::JSON->>'job_id' AS job_id, line::JSON->>'issue_type' AS issue_type, COUNT(*) AS n FROM feedback WHERE json_valid(line) AND line NOT LIKE '%"refund"%' GROUP BY 1,2""")
def _(t: Tables):
    src, ok, bad, ckpt = (scratch(t, n) for n in ("lines", "accepted", "rejected", "ckpt"))
    t("feedback").select(F.col("line").alias("value")).write.text(src)
    streams.stream_feedback(t.spark, src, ok, bad, ckpt).awaitTermination()
    return t.spark.read.parquet(f"{ok}/*").groupBy("job_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_job_state", """WITH e AS (SELECT owner AS job_id, CAST(updated_at AS DATE) AS ts, job_id AS seq, state FROM job), d AS (SELECT job_id, state FROM e WHERE state IN ('succeeded','failed') QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts, seq)=1),
l AS (SELECT job_id, state FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC)=1) SELECT l.job_id, COALESCE(d.state, 'stale') AS state FROM l LEFT JOIN d USING (job_id)""")
def _(t: Tables):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = t("job").select(F.col("owner").alias("job_id"), F.to_timestamp(F.to_date("updated_at")).alias("ts"), F.col("job_id").alias("seq"), "state")
    # an event of another job, long after the last, lets every timer fire
    after = e.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("job_id"), "ts", F.lit(0).cast("long").alias("seq"), F.lit("succeeded").alias("state"))
    out = _finish(t, streams.stream_job_state(_as_stream(t, e.unionByName(after.select(*[F.col(c).cast(d).alias(c) for c, d in e.dtypes])), "events"), 86400), "append").where("job_id >= 0")
    final = out.groupBy("job_id").agg(F.max_by("state", F.struct("ts", F.col("state") == "stale", "accepted")).alias("last"), F.max(F.when(F.col("state").isin("succeeded", "failed") & F.col("accepted"), F.col("state"))).alias("end"))
    return final.select("job_id", F.coalesce("end", "last").alias("state"))
