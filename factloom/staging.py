"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a driver and executors in one process (``local[...]``, as in tests) get a temporary
    folder; on a cluster that would be a different folder on each machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; ``clean`` removes it once no result is read any more."""
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in any store that Spark writes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Remove what this application staged."""
    remove(spark, run_dir(spark))


class Scratch:
    """The paths made inside a ``scratch``, in order."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self._outer = _OPEN[-1] if _OPEN else None

    def keep(self, since: int = -1) -> list[str]:
        """Leave the paths from ``since`` on (the last one) to the scratch around this one, if there is one."""
        kept, self.paths[since:] = self.paths[since:], []
        if self._outer is not None:
            self._outer.paths += kept
        return kept


_OPEN: list[Scratch] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table that this application writes; a ``scratch`` around it removes it."""
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Paths made inside are removed at the end, but for those kept. What reads them must be done by then."""
    made = Scratch()
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        for path in made.paths:
            remove(spark, path)


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
