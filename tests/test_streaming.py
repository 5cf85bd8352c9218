from pyspark.sql import functions as F

from maploom.streaming import tasks


def test_last_state_of_each_task(spark, tmp_path):
    rows = [(1, 1, "PENDING", 0, 6), (1, 2, "PROGRESS", 2, 6), (2, 1, "PROGRESS", 1, 6), (1, 3, "SUCCESS", 6, 6), (2, 5, "FAILURE", 1, 6), (2, 4, "PROGRESS", 5, 6), (3, 9, "PROGRESS", 1, 3)]
    log = spark.createDataFrame(rows, "task_id long, t long, state string, current long, total long").select("task_id", F.timestamp_seconds("t").alias("ts"), "state", "current", "total")
    for k in range(2):
        log.where(F.col("task_id") % 2 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, df, mode in (("last", tasks.states(source), "complete"), ("first", tasks.first_reports(source), "append")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert {(r.task_id, r.state, r.percent) for r in spark.table("last").collect()} == {(1, "SUCCESS", 100.0), (2, "FAILURE", 0.0), (3, "PROGRESS", 33.33)}
    assert spark.table("first").count() == 6
