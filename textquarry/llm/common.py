"""What the operators of this subpackage share: tables, the shared scratch folder, text rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII separators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, UPPER, LOWER)


#: The temporary folder of each application that names none; the setting itself cannot be changed once Spark runs.
_fallbacks: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and one machine does all, as in tests, a temporary one."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _fallbacks.get(app)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _fallbacks[app] = tempfile.mkdtemp(prefix="textquarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of ``path``, and the path as it takes it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends, or by ``discard``."""
    path = f"{shared_dir(spark)}/textquarry-{uuid.uuid4().hex}"
    files, jpath = _file_system(spark, path)
    files.deleteOnExit(jpath)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Frees a scratch path whose rows no later step reads."""
    files, jpath = _file_system(spark, path)
    files.delete(jpath, True)


def written(df: DataFrame, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """The rows of ``df``, written once as a table in the shared folder and read back.

    It cuts the lineage as checkpoint() does, keeps columns prunable, and outlives any executor. The files
    go when the driver's JVM ends, or when ``path``, where given, is discarded.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, or with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
