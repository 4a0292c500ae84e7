"""Scoring of a stream of events against the subscriber table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbtide import schema as S
from ebbtide.functions import risk
from ebbtide.functions.numeric import half_even
from ebbtide.operators.score import at_least

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
#: The ledger of written ids: 65,536 neighbouring ids lie in one folder, of which there are at most BUCKETS.
RUN_BITS, BUCKETS = 16, 1024
LEDGER_SCHEMA = "event_id bigint, bucket int, batch bigint"


def read_events(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """A stream of the event files in a folder; ``ts`` as a timestamp, so that it can carry a watermark."""
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", files)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def score_events(
    events: DataFrame,
    subscribers: DataFrame,
    threshold: float = S.DEFAULT_THRESHOLD,
    salts: int = 8,
) -> DataFrame:
    """One scored row per event, for a stream or a table of events.

    ``subscribers`` is a static scored table with c_custkey and churn_probability, of
    which just these two columns are read. A streaming join is not re-planned at run
    time, so the events of a busy user are spread over ``salts`` join keys, for which
    each subscriber comes ``salts`` times. An event of an unknown subscriber is kept,
    without a probability.
    """
    p = F.col(S.PROBABILITY)
    known = subscribers.select(
        F.col("c_custkey").alias("user_id"),
        S.PROBABILITY,
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")
    return (
        events.withColumn("salt", salt)
        .join(known, ["user_id", "salt"], "left")
        .select(
            "event_id",
            "user_id",
            half_even(p * 100).alias("ChurnProbability"),
            at_least(p, threshold).alias("ChurnPrediction"),
            risk.risk_label(p).alias("RiskLabel"),
        )
    )


def bucket_of(event_id: Column) -> Column:
    """The ledger folder of an event: neighbouring ids share one, and there are never more than BUCKETS."""
    return F.pmod(F.shiftright(event_id, RUN_BITS), F.lit(BUCKETS)).cast("int")


def _names(spark: SparkSession, path: str) -> set[str]:
    """What lies in a folder, nothing if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in files.listStatus(target)} if files.exists(target) else set()


def _note(scored: DataFrame, ledger: str) -> None:
    """Write the ids of scored (event_id, batch) into the ledger; a batch that is noted again replaces what it noted."""
    ids = scored.select("event_id", bucket_of(F.col("event_id")).alias("bucket"), "batch")
    writer = ids.repartition("bucket").sortWithinPartitions("bucket", "batch", "event_id").write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(ledger)


def known_ids(spark: SparkSession, ledger: str, ids: DataFrame, batch_id: int) -> DataFrame | None:
    """The event_id of events like `ids` that other batches have written; reads the buckets of these ids only.

    The driver gets the numbers of the buckets, at most BUCKETS, and the least and largest id, by which Parquet leaves out files.
    """
    found = ids.agg(
        F.collect_set(bucket_of(F.col("event_id"))).alias("buckets"),
        F.min("event_id").alias("least"),
        F.max("event_id").alias("most"),
    ).first()
    folders = sorted({f"bucket={b}" for b in found["buckets"]} & _names(spark, ledger))
    if not folders:
        return None
    noted = spark.read.schema(LEDGER_SCHEMA).option("basePath", ledger).parquet(*(f"{ledger}/{x}" for x in folders))
    near = F.col("event_id").between(found["least"], found["most"])
    return noted.where(near & (F.col("batch") != batch_id)).select("event_id")


def write_scores(scored: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write one folder per batch; a batch that is run again replaces its folder.

    An event is written once however often and however late it comes: a ledger beside the scores holds the ids of what
    was written, in folders by id, and a batch reads those of its own ids only. No state is kept, nothing is lost to a
    watermark, and what a batch reads follows its ids, not the size of the sink. A sink without a ledger gets one first.
    Events without an id are told apart by nothing: the first of a batch is written, as with any other id.
    """
    ledger = f"{output}/_ledger"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        written = _names(spark, output)
        if "_ledger" not in written and any(name.startswith("batch=") for name in written):
            _note(spark.read.parquet(output).select("event_id", F.col("batch").cast("bigint").alias("batch")), ledger)
        fresh = batch.dropDuplicates(["event_id"])
        others = known_ids(spark, ledger, batch.select("event_id"), batch_id)
        if others is not None:
            fresh = fresh.join(others, "event_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        added = spark.read.schema(batch.schema).parquet(f"{output}/batch={batch_id}")
        _note(added.select("event_id", F.lit(batch_id).cast("bigint").alias("batch")), ledger)

    writer = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
