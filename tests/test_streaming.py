import random

from pyspark.sql import functions as F

from longspan.operators import sequence
from longspan.streaming.memory import stream_memory_features


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, k, int(rng.random() < 0.2)) for c in range(6) for k in range(30)]
    panel = spark.createDataFrame(rows, "cell_id long, k int, y int").select("cell_id", F.expr("add_months(date'2015-01-01', k)").alias("date"), "y")
    for low, high in ((0, 11), (12, 12), (13, 29)):  # a year, a month, the rest
        part = panel.where(f"months_between(date, date'2015-01-01') between {low} and {high}")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_memory_features(stream, 9).writeStream.format("memory").queryName("memory_features").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    names = ["cell_id", "date", "y", "y_lag1", "event_count", "months_since_event"]
    got = sorted(tuple(r) for r in spark.table("memory_features").select(*names).collect())
    want = sequence.memory_features(panel, 9).withColumnRenamed("event_count_12m", "event_count").select(*names)
    assert got == sorted(tuple(r) for r in want.collect())
