"""The folder that all executors share, for checkpoints and tables between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a folder of our own where it is unset (tests on one machine)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="rankloom-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is read in fewer parts than there are, as from a file of one row group; a large table has
    more parts and stays as it is. Not for what depends on the order of rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():
        return df
    return df if run.toRdd().getNumPartitions() >= cores else df.repartition(cores)
