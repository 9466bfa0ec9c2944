"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "depotlens") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Sends this package to the executors, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if any(path.endswith("/depotlens.zip") for path in context._jsc.sc().listFiles().mkString("\n").split("\n")):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="depotlens-package-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "depotlens"), "zip", root, "depotlens"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder.  On a cluster an
    unset folder is an error, because files on one machine are lost with it.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-depotlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A place for a new table in the shared folder."""
    return f"{shared_dir(spark)}/depotlens-{name}-{uuid4().hex}"


def written_to(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a new Parquet table at ``path``, read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder, read back.

    Like :func:`cut_lineage`, but later reads take only the columns they need.
    """
    return written_to(df, new_folder(df.sparkSession, name))


def bucketed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`written_table`, dealt by ``key``: joins and groupings on it leave these rows where they are."""
    spark, known = df.sparkSession, f"depotlens_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fewer would be shuffled again
    df.write.option("path", new_folder(spark, name)).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(known)
    stored = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # only the catalog's entry: the files are the shared folder's
    return stored
