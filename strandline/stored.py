"""Tables written to the shared folder, to cut lineage where a plan uses them several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written under spark.checkpoint.dir and read again: a lost executor costs a reread, never a rerun.

    Without that setting, a local session gets a folder of its own; any other is refused, as its executors share none. The
    table goes when the application ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/strandline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
