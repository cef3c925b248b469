"""Places that all executors share: written tables and checkpoints.

Lineage is cut by writing a table into the folder named by
``spark.checkpoint.dir``; a lost executor then costs only its running tasks.
The folder is read from the session. Only where it is unset and the master is
a single local JVM (as in tests) does the engine choose a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from corvane.errors import CorvaneError

_own_dirs: dict[str, str] = {}
_to_clear: set[str] = set()


def _clear_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes the application's written tables when the driver's Python ends."""
    if path in _to_clear:
        return
    _to_clear.add(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()

    def clear() -> None:
        try:
            hadoop.getFileSystem(conf).delete(hadoop, True)
        except Exception:  # the JVM may be gone; the folder's owner clears it then
            pass

    atexit.register(clear)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables, shared by all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise CorvaneError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


def home_dir(spark: SparkSession) -> str:
    """The application's folder in `shared_dir`, deleted when its driver ends."""
    home = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}"
    _clear_at_exit(spark, home)
    return home


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("corvane_scopes", default=())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Unlike ``checkpoint()`` the copy is columnar and compressed, so it costs a
    fraction of the disk, and later readers prune its columns. The table is
    deleted by `free`, at the end of a `scratch` block, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{home_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    for scope in _scopes.get()[-1:]:
        scope.append((spark, path))
    return table


def free(*tables: DataFrame) -> None:
    """Deletes tables made by `materialise`, once all that was made of them is written itself."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            _delete(table.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """A block at whose end the tables written inside it are deleted; results are to be written or collected before."""
    mine: list[tuple[SparkSession, str]] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for spark, path in mine:
            _delete(spark, path)
