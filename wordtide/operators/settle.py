"""Tables that are read more than once are written once, to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Where the setting is absent, in a local session, a temporary folder becomes the setting; it goes when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wordtide-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/settled-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: nothing that reads it computes it again. One that is such a table stays as it is."""
    if getattr(df, "_settled", False):
        return df
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = True
    return out
