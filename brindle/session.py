"""Session and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def get_spark(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on: ANSI, UTC, adaptive execution.

    Settings given as keywords use ``__`` for dots.  An existing session is reused, so on a cluster
    the submitter's settings win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Tables by session, path and the time and size its file status had.
_TABLES: dict[tuple, DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory, columns and row groups pruned by the reader.

    A table is looked up once in a session and again only when the path's file status has changed: reading its schema
    is a job.
    """
    path = f"{sf_dir}/{name}.parquet"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (id(spark), spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen())
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make tables visible to SQL as temporary views."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local session may lack that setting and gets a temporary folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"
