"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import contextvars
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", app: str = "amalgam", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    os.environ.setdefault("TZ", "UTC")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a master on one machine gets a temporary one;
    any other is an error, for executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="amalgam-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []
#: Tables written since the outermost ``scratched`` call of this context began.
_scratch: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scratch", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a table written to the
    shared folder, so a lost executor loses none of its rows. The table is
    deleted by ``drop`` or at the end of the program."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/amalgam/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    if (scratch := _scratch.get()) is not None:
        scratch.append(table)
    return table


def scratched(f: Callable) -> Callable:
    """For functions that return a DataFrame, or a tuple of them: their results are
    written, and every table they cut on the way is dropped, so that a session
    keeps one table a call. Calls may stand in one another."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        made: list[DataFrame] = []
        token = _scratch.set(made)
        try:
            found = f(*args, **kwargs)
        finally:
            _scratch.reset(token)
        several = isinstance(found, tuple)
        kept = [x if getattr(x, "written_to", None) else cut(x) for x in (found if several else (found,))]
        paths = {x.written_to for x in kept}
        drop(*[x for x in made if x.written_to not in paths])
        if (outer := _scratch.get()) is not None:
            outer.extend(x for x in kept if x not in outer)
        return tuple(kept) if several else kept[0]

    return run


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [(s, p) for s, p in _written if p != path]


@atexit.register
def _delete_all() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended: local folders can still go
            shutil.rmtree(path.removeprefix("file:").replace("///", "/"), ignore_errors=True)


#: Rows up to which a side counted beforehand is broadcast; larger ones shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
