"""Tables that jobs write for later steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir (below a temporary folder in local mode where it is unset)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.gettempdir() + "/evidentia-rounds"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Rows up to which Spark may send a written table whole to the driver and to every executor.
SMALL = 100_000


#: Rows that one task sorts or groups, about.
SHARE = 500_000


def shares(*tables: DataFrame) -> int:
    """Tasks to deal the tables' rows out to, so that a task's memory doesn't grow with them; not fewer than a shuffle has."""
    n = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, -(-sum(df.count() for df in tables) // SHARE))


def marked(df: DataFrame) -> DataFrame:
    """The table, to be joined by a shuffle if it has over SMALL rows.

    Spark judges a table in files by their size, and a few megabytes of well packed files can hold more rows than a driver
    can."""
    return df.hint("merge") if df.count() > SMALL else df


def counted(df: DataFrame, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """The table, written and read back, and marked if it is large; and its number of rows, with whatever else is to be counted.

    Counts are taken while rows are written: a query of its own for each costs the driver threads, which Spark keeps for a
    minute each."""
    path, seen = new_folder(df.sparkSession), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in more.items()]).write.option("compression", "zstd").parquet(path)
    table, found = df.sparkSession.read.schema(df.schema).parquet(path), seen.get
    return table.hint("merge") if found["rows"] > SMALL else table, found


def saved(df: DataFrame) -> DataFrame:
    """The table, written and read back, and marked if it is large."""
    return counted(df)[0]
