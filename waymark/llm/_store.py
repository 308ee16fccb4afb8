"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; its own one only where none is set.

    Without the setting a local session takes a temporary folder, and a cluster takes
    a relative path, which lies in its default file system; the context keeps it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-") if context.master.startswith("local[") or context.master == "local" else ".waymark")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            deleted(df.sparkSession, folder)


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns) -> str:
    """A column name like `name` that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def text_of(name: str = "text"):
    """The text column with null as an empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fold_of(name: str, folds: int):
    """crc32 of the key as decimal text, modulo folds; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def carried(df: DataFrame, own: list[str], without: str = "") -> list[str]:
    """The columns of df that a result keeps: all but those with the name of a result column, whatever its case, and but one more."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken and c != without]


def quoted(names) -> list:
    return [F.col(f"`{c}`") for c in names]


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with the fields of a DDL string behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
