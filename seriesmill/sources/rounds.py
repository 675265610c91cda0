"""Tables of an iterative operator, written to the folder that all executors share.

A round's rows are written below ``spark.checkpoint.dir`` and read again, so a lost
executor costs a round at most and plans do not grow with the rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where it is unset, a temporary folder in local mode, else an error:
    other machines do not see this one's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="seriesmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/seriesmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
