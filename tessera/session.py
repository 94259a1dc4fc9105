"""Session helpers: a default session and tables written to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset on a
    local master (as in tests) a temporary folder is made and set for the
    session. Elsewhere a folder of one machine would be wrong, so this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: The open scopes, innermost last; each lists the paths written in it.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the
    true size, so small tables are broadcast and large ones are not. Inside
    ``scratch`` the table is deleted when the scope ends.
    """
    path = shared_path(df.sparkSession, label)
    for scope in _scopes.get()[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose tables are deleted at its end, but for those written by the function it gives.

    That function is ``materialize`` for results: what it writes belongs to the
    scope around this one. Nothing that is read later may depend on the
    deleted tables, so all that leaves the scope has to be written by it.
    """
    outer, mine = _scopes.get(), []
    token = _scopes.set((*outer, mine))

    def result(df: DataFrame, label: str) -> DataFrame:
        inner = _scopes.set(outer)
        try:
            return materialize(df, label)
        finally:
            _scopes.reset(inner)

    try:
        yield result
    finally:
        _scopes.reset(token)
        delete(spark, mine)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system, whatever scheme they have."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def bound_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Let Arrow batches of whole texts hold a few megabytes at most (one longer text makes a batch of its own).

    Plans read this setting when they run, so it can't be put back when an
    operator returns; it stays for the session and is only ever lowered.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))
