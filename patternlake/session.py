"""Session settings for local work, and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    settings = {
        "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="patternlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again: work isn't repeated, and a lost executor costs no lineage."""
    df.write.parquet(path := shared_path(df.sparkSession, "cut"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, base: str) -> list[int]:
    """Numbers n of the tables base/n that were written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [x.getPath().getParent().getName() for x in found]
    return sorted(int(x) for x in names if x.isdigit())
