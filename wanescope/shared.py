"""Tables in the folder that driver and executors share: they cut a lineage, survive lost executors and fix the order of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (local mode only)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-wanescope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of tables that `written` made and that haven't been released, with their sessions.
_OPEN: list[tuple[str, SparkSession]] = []


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, survives lost executors and fixes the order of rows."""
    path = f"{shared_dir(df.sparkSession)}/wanescope-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    # shuffle files go when the driver's garbage collector finds that nothing refers to them, which may be long after
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _OPEN.append((path, df.sparkSession))
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the folders of tables that `written` returned, once whatever needs their rows has been written itself."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            _deleted(t.sparkSession, path)
            _OPEN[:] = [x for x in _OPEN if x[0] != path]


def opened() -> list[str]:
    """Folders of the tables that `written` made and that are there still."""
    return [path for path, _ in _OPEN]


def released_but(docs: DataFrame, paths: list[str]) -> None:
    """Deletes the tables in these folders, but for those that docs is read from."""
    if not paths:
        return
    files = docs.inputFiles()
    for path, owner in [x for x in _OPEN if x[0] in paths]:
        if not any(path.rpartition("/")[2] in f for f in files):
            if owner.sparkContext._jsc is not None:
                _deleted(owner, path)
            _OPEN.remove((path, owner))
