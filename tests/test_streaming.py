from pyspark.sql import functions as F

from tessella.streaming.events import describe_stream, distinct_events, type_counts, user_sessions

D = "/root/testdata/sf0.001/events.parquet"


def run(spark, build, name, mode="complete"):
    schema = spark.read.parquet(D).schema
    q = build(spark.readStream.schema(schema).parquet(f"{D[: D.rindex('/')]}", pathGlobFilter="events.parquet")).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_equal_batch(spark):
    batch = spark.read.parquet(D)
    for build, name in ((lambda e: type_counts(e, "7 days"), "types"), (lambda e: describe_stream(e, "7 days"), "described")):
        live = run(spark, build, name)
        both = [sorted(map(tuple, x.select(*[F.round(c, 6) if t == "double" else F.col(c) for c, t in x.dtypes]).collect()), key=str) for x in (live, build(batch))]
        assert both[0] == both[1] and both[0]


def test_sessions_and_repeats(spark):
    live = run(spark, lambda e: user_sessions(e, "2 days"), "live_sessions", "append")
    assert live.count() <= user_sessions(spark.read.parquet(D), "2 days").count()
    assert run(spark, lambda e: distinct_events(e), "live_distinct", "append").count() == spark.read.parquet(D).select("event_id").distinct().count()
