"""Session settings and table loading shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.errors import Refusal

#: What every session of this engine relies on. Sizes are left to the cluster.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def make_session(master: str = "local[8]", app: str = "vantidal", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    conf = CONF | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | extra
    spark = SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; zoneless timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and everything runs on one machine (tests) a local folder is used; a cluster
    without the setting is refused.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise Refusal("invalid_arguments", "No folder is shared by the driver and the executors.", "Set spark.checkpoint.dir.")
        import tempfile

        set_to = tempfile.mkdtemp(prefix="vantidal-shared-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def through_store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when `forget` is called, or when the application ends.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames from `through_store` that nothing will read again, and of those they were made from
    (`_reads`)."""
    for df in frames:
        forget(*getattr(df, "_reads", ()))
        if path := getattr(df, "_stored_at", None):
            fs, p = _file_system(df.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)
            df._stored_at = None
