"""Session helpers: shared staging folder, code shipping, table loading."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_own_dir: list[str] = []
#: Staged tables that are still there: path -> its file system and folder.
_staged: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir.

    Where it is unset, a session in local mode (tests, one machine) gets a private folder; a cluster
    has no such folder, so there the setting must be given.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lymphframe-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    The table stays until unstage() or the end of the program.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the staged tables."""
    path = f"{shared_dir(spark)}/lymphframe-{uuid.uuid4().hex}/{name}"
    if not _staged:
        atexit.unregister(unstage_since)
        atexit.register(unstage_since, frozenset())
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    _staged[path] = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p.getParent()
    return path


def _delete(path: str | None) -> None:
    if path in _staged:
        files, folder = _staged.pop(path)
        try:
            files.delete(folder, True)
        except Exception as e:  # the session may have ended before the program
            if _own_dir and path.startswith(f"file://{_own_dir[0]}"):
                return  # goes with its folder
            print(f"left behind: {path} ({type(e).__name__})", file=sys.stderr)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        _delete(getattr(df, "_staged_at", None))


def staged() -> frozenset[str]:
    """The staged tables that are there now, for unstage_since()."""
    return frozenset(_staged)


def unstage_since(before: frozenset[str], *keep: DataFrame) -> None:
    """Delete all tables staged after `before` was taken but those to keep: a job calls it when its result is written."""
    left = {getattr(df, "_staged_at", None) for df in keep}
    for path in list(_staged):
        if path not in before and path not in left:
            _delete(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a SparkContext, wherever their working folder is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="lymphframe-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, "lymphframe_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
