"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# One block of an ordered scan spans this many consecutive positions, so no task ever holds more rows of one key.
BLOCK_ROWS_CONF = "foldstone.block.rows"
BLOCK_ROWS_DEFAULT = 65536

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC days, adaptive plans, skew splitting)."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldstone")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. A local master may do without and gets a temporary one, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="foldstone-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; used between the rounds of iterative work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_path(df: DataFrame) -> str:
    """Write a result as Parquet below the shared folder and return where."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


_STAGES: list[str] = []


def drop_stages(spark: SparkSession) -> int:
    """Delete the intermediate results that ``stage`` wrote; call it once their readers are done."""
    files = spark._jvm.org.apache.hadoop.fs.Path
    configuration = spark._jsc.hadoopConfiguration()
    dropped = 0
    while _STAGES:
        path = files(_STAGES.pop())
        dropped += bool(path.getFileSystem(configuration).delete(path, True))
    return dropped


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, as Parquet in the shared folder.

    Readers keep column pruning and filter pushdown, the log is parsed once, and a lost executor costs a re-read.
    """
    path = staged_path(df)
    _STAGES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
