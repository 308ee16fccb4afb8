"""Cutting lineage in iterative queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(df: DataFrame) -> str:
    """The shared folder that the session names; only a local session without one takes a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or (tempfile.mkdtemp() if context.master.startswith("local[") else ".checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, for rounds whose tables `dropped` deletes."""
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession) -> int:
    """Tasks that work is dealt over that is large for its input: some for each core."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a task that sorts or holds what it works on.
ROWS_HELD = 1 << 18


def tasks_over(df: DataFrame, rows: int | None = None) -> int:
    """Tasks for work that holds its rows: as many more as the rows are, so that a task's memory doesn't grow with the input. Counts df if rows isn't given."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(df.count() if rows is None else rows) // ROWS_HELD))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over tasks, for work that costs far more than reading its rows: a small file, or a row group of millions of narrow rows, is one task."""
    return df.repartition(tasks_for(df.sparkSession))
