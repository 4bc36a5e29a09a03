"""Many small batches are listed by few tasks."""

from cohortweave.sources import tables


def _tasks(spark, run):
    """Tasks of all jobs of ``run``, and what it returns."""
    sc = spark.sparkContext
    sc.setJobGroup("batch-files", "")
    try:
        made = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    infos = [status.getStageInfo(s) for j in status.getJobIdsForGroup("batch-files") for s in status.getJobInfo(j).stageIds]
    return [i.numTasks for i in infos if i is not None], made


def test_folders_are_not_listed_by_a_task_each(spark, folder):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.range(0, 300).selectExpr("id", "id AS batch_id").write.partitionBy("batch_id").parquet(f"{folder}/c")
    listed, back = _tasks(spark, lambda: tables.read_batches(spark, f"{folder}/c"))
    assert max(listed) <= tables.LIST_TASKS * spark.sparkContext.defaultParallelism < 300
    assert back.count() == 300
    assert spark.conf.get(key, None) == before
