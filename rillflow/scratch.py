"""Tables and folders for the time of a job, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of stored() lie, as long as they are in use.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder. Only a local session may leave the setting out."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        root = context.getCheckpointDir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df computed once: what depends on how rows were dealt stays as it was, whatever is read again or lost.

    The table stays until drop() or until the shared folder is emptied.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more, results not yet computed included; other frames are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
