"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glossmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    session is purely local does this make a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="glossmill-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so a lost executor costs no recomputation.

    Spark removes a checkpoint that nothing refers to any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``session`` does.
    """
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of written tables that are still there, each with its session.
_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed columnar table in the shared folder; for tables that are read by parts of their columns.

    ``drop_written`` removes the folders, at the latest when the program ends.
    """
    spark = df.sparkSession
    folder = f"{shared_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _WRITTEN.append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


@atexit.register
def drop_written() -> None:
    """Remove every table that ``written`` made; what was read from them is not to be used any more."""
    while _WRITTEN:
        spark, folder = _WRITTEN.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  (the session has ended before)
            continue
