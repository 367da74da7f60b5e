"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "file_groups log_sources patterns occurrences tags raw_entries source_scans source_zones eval_items mix_targets"
).split()


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-JVM session with the settings the tests and the bench use."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strataloom")
    for key, value in base.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, wherever the driver has it from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="strataloom-code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"{home.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset in local mode."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(where)
        return where
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{root}/data"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    ship(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has too few partitions for them (a single small file); else as it is."""
    ship(df.sparkSession)
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # has exchanges; to ask it would run them
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


#: Rows and bytes up to which a side of a join is sent to every task.
SMALL_ROWS, SMALL_BYTES = 100_000, 64 << 20


def small(df: DataFrame, most: int = SMALL_ROWS, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """A materialised side of a join, marked for broadcast if its rows and the bytes of its values, both measured here,
    are few; else as it is. Which of the two plans is taken changes no result."""
    sizes = [F.octet_length(c) if t == "string" else F.octet_length(F.to_json(F.struct(c))) if t.startswith(("array", "map", "struct")) else F.lit(16) for c, t in df.dtypes]
    width = F.lit(16)
    for x in sizes:
        width = width + F.coalesce(x, F.lit(16))
    rows, taken = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and taken <= most_bytes else df
