"""Session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a temporary one serves if everything runs on this machine; a cluster needs the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="alphaloom-")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def passing_dir(spark: SparkSession, name: str) -> str:
    """As new_dir, for tables that a query's tasks read by themselves; it is removed when the driver's Python ends."""
    path = new_dir(spark, name)

    def remove() -> None:
        system, place = _open(path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)

    atexit.register(remove)
    return path


def read_under(path: str, columns: list[str]) -> pa.Table | None:
    """Columns of a folder's Parquet files, in one chunk each; None if there is no file."""
    system, place = _open(path)
    found = [pq.read_table(f.path, columns=columns, filesystem=system, partitioning=None, use_threads=False) for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.path.endswith(".parquet")]
    return pa.concat_tables(found).combine_chunks() if found else None


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context: their Python may not find it otherwise."""
    context = spark.sparkContext
    if getattr(context, "_alphaloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.parent.is_dir():  # else the package itself was shipped
        out = Path(tempfile.mkdtemp(prefix="alphaloom-")) / "alphaloom.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        context.addPyFile(str(out))
    context._alphaloom_shipped = True
