from pyspark.sql import functions as F

from apexframe.operators.policy import run_alerts
from apexframe.plans.registry import POLICY
from apexframe.plans.surrogate import scores
from apexframe.streaming.alerts import stream_alerts
from twins import DATA


def test_stream_equals_batch_replay(spark, tmp_path):
    rows = scores(spark, DATA)
    # Three files, each with the next part of every car's rows.
    for i in range(3):
        part = rows.where(F.col("frame_index").between(i * 30, i * 30 + 29 if i < 2 else 10**9))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_alerts(stream, 0.1, POLICY).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = run_alerts(rows, [0.1], POLICY).where("resolution_type != 'stream_end'")
    names = ["circuit", "car_id", "proposal_number", "proposal_time", "resolution_time", "resolution_type"]
    assert sorted(map(tuple, spark.table("alerts").select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))
