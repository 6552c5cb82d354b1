"""Tables that end a lineage: written to the folder that the cluster shares, then read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset a local session gets a temporary folder; any other is
    refused, since executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="evigraph-")
    return _LOCAL[app]


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/evigraph-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` as a table in the shared folder, and its rows (or another count), counted as they are written."""
    seen = Observation()
    table = settle(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("rows")), tag)
    return table, seen.get["rows"]


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that settle() wrote, once no later plan reads them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/evigraph-" in folder:
                delete(df.sparkSession, folder)


def joined(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """The union of settled tables as one, after which they are deleted."""
    parts = list(parts)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    out = settle(whole, tag)
    release(*parts)
    return out
