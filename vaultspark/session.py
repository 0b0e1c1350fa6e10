"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import pathlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; all of them can be changed at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_staging: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=SETTINGS)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. On one machine (tests) a temporary folder stands in where it is unset; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vaultspark-")
        atexit.register(shutil.rmtree, found, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vaultspark/{spark.sparkContext.applicationId}"


def stage_table(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; lineage ends there and survives lost executors.

    The stages of an application lie in one folder. It is deleted by drop_stages, or when the driver ends, as lazy results may
    read them until then.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _staging:
        _staging.add(app)
        atexit.register(_clean, spark)
    path = f"{_stages(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a stage_table once nothing reads it any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, path)


def drop_stages(spark: SparkSession) -> None:
    """Delete all stages of this application; results that read them must have been written by then."""
    _delete(spark, _stages(spark))


def _clean(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped yet
        drop_stages(spark)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition only where a table has fewer files than half the cores, so that one small file doesn't become one task."""
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for sessions whose workers can't import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = pathlib.Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="vaultspark-code-")  # read by executors until the session ends
    atexit.register(shutil.rmtree, tmp, True)
    shutil.copytree(home, f"{tmp}/tree/{home.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tmp}/{home.name}", "zip", f"{tmp}/tree"))
    _shipped.add(app)
