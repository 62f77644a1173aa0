"""Session helpers of all operators: the shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_MADE: list[tuple[SparkSession, str]] = []
_SCOPE: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set once for a session
    whose executors are threads of the driver (tests); on a cluster that would be
    another folder on each machine, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="acervo-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed with the command around it or when the driver exits."""
    path = f"{shared_dir(spark)}/acervo-{label}-{uuid.uuid4().hex}"
    made = _SCOPE.get()
    (_MADE if made is None else made).append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; nothing depends on this
            continue


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages then restart from replicated files instead of recomputing, so
    a lost executor costs one task; the plan above it is dropped.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that are written inside, once the command around it is done.

    Each command has a scope of its own, also where several run at once.
    """
    mine: list[tuple[SparkSession, str]] = []
    outer = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for _, path in mine:
            remove(spark, path)


AT_ONCE = 6


def together(*jobs: Callable[[], T]) -> list[T]:
    """Run independent jobs from threads of their own: planning and small stages of one fill the pauses of another.

    Results come in order; the first error is raised after all have ended.
    """
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(AT_ONCE, len(jobs))) as pool:
        running = [pool.submit(copy_context().run, job) for job in jobs]
    return [r.result() for r in running]


HOT = 1024


def counted_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``side``, which holds each key once (nulls are a key) and in ``weight`` its number of rows.

    Keys that hold more than a ``HOT`` th of the ``total`` rows, fewer than ``HOT`` of
    them, are broadcast, so their rows stay where they are; the others meet by a
    hash join.  Rows without a key in ``side`` are left out.
    """
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    more = [F.col(f"r.{c}") for c in side.columns if c not in keys]
    heavy = F.col(weight) * HOT > total
    hot, cold = side.where(heavy), side.where(~heavy)
    met = rows.alias("l").join(F.broadcast(hot.alias("r")), same).select("l.*", *more)
    others = rows.alias("l").join(F.broadcast(hot.select(*keys).alias("r")), same, "left_anti")
    return met.unionByName(others.alias("l").join(cold.alias("r"), same).select("l.*", *more))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many ``_`` behind it as no column of ``columns`` has (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
