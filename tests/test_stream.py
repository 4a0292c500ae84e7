from conftest import rows
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.operators.score import rule_scorer
from ebbtide.sources.subscribers import subscribers_with_key
from ebbtide.streaming.scoring import EVENT_SCHEMA, known_ids, read_events, score_events, write_scores

SHOWN = ["event_id", "user_id", "ChurnProbability", "ChurnPrediction", "RiskLabel"]


def test_stream_equals_batch_and_drops_repeats(spark, sf, tmp_path):
    known = rule_scorer(subscribers_with_key(spark, sf)).select("c_custkey", S.PROBABILITY).persist()
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    repeated = events.union(events.filter("event_id % 20 = 0"))
    stranger = events.limit(1).withColumns({"event_id": F.lit(10**9), "user_id": F.lit(10**9)})
    repeated.union(stranger.select(events.columns)).repartition(4).write.parquet(str(folder))

    scored = score_events(read_events(spark, str(folder), "*.parquet"), known)
    write_scores(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = score_events(events, known)
    assert rows(found.filter("user_id < 1000000000"), *SHOWN) == rows(expected, *SHOWN)
    unknown = found.filter("user_id = 1000000000").first()
    assert (unknown["ChurnProbability"], unknown["RiskLabel"]) == (None, "Very High Risk")

    # A file a week older, with repeats of written events: only what is new comes out.
    late = events.limit(10).withColumns({"event_id": F.col("event_id") + 2 * 10**9, "ts": F.col("ts") - F.expr("INTERVAL 7 DAYS")})
    late.select(events.columns).union(events.limit(5)).write.mode("append").parquet(str(folder))
    write_scores(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == events.count() + 11 and found.select("event_id").distinct().count() == found.count()

    # A third run finds nothing new.
    write_scores(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == found.count()


def test_a_batch_reads_the_ledger_of_its_own_ids_only(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    known = spark.createDataFrame([(1, 0.25)], "c_custkey bigint, churn_probability double")
    run = 1 << 16
    read = []
    for k in range(5):
        # A run of new ids, and one id of the first run again.
        ids = [*range(k * run, k * run + 40), 7]
        rows = spark.createDataFrame([(i, None, 1, "view", 1.0, None) for i in ids], EVENT_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(folder)
        new = rows.where(f"event_id >= {k * run}")
        seen = known_ids(spark, f"{out}/_ledger", new, -1)
        read.append(0 if seen is None else len(seen.inputFiles()))
        scored = score_events(read_events(spark, folder, "*.parquet"), known)
        write_scores(scored, out, state).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == found.select("event_id").distinct().count() == 5 * 40
    assert read == [0] * 5
    again = known_ids(spark, f"{out}/_ledger", spark.createDataFrame([(7,)], "event_id bigint"), -1)
    assert len(again.inputFiles()) == 1 and [r.event_id for r in again.collect()] == [7]


def test_a_sink_without_a_ledger_gets_one_and_a_batch_run_again_replaces_itself(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    known = spark.createDataFrame([(1, 0.25)], "c_custkey bigint, churn_probability double")
    events = spark.createDataFrame([(i, None, 1, "view", 1.0, None) for i in (1, 2, 3, None, None)], EVENT_SCHEMA)
    events.write.parquet(folder)
    old = score_events(events.where("event_id = 2"), known)
    old.write.parquet(f"{out}/batch=99")
    for state in ("first", "second"):
        # The second run has lost its checkpoint and runs batch 0 again.
        scored = score_events(read_events(spark, folder, "*.parquet"), known)
        write_scores(scored, out, str(tmp_path / state)).awaitTermination()
        found = sorted((r.event_id is None, r.event_id or 0, r.batch) for r in spark.read.parquet(out).collect())
        assert found == [(False, 1, 0), (False, 2, 99), (False, 3, 0), (True, 0, 0)]
