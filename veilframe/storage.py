"""The folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from .errors import ExecutionBackendError

_KNOWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, but only
    on one machine, as on a cluster every machine would have one of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ExecutionBackendError("set spark.checkpoint.dir to a folder that all machines share")
        if sc.applicationId not in _KNOWN:
            _KNOWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="veilframe-")
        root = _KNOWN[sc.applicationId]
    return root.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one. Results are read
    from it as long as the application runs; it goes when the driver ends, or
    by ``clear``."""
    folder = f"{shared_root(spark)}/veilframe-{spark.sparkContext.applicationId}"
    if folder not in _KNOWN:
        _KNOWN[folder] = folder
        atexit.register(_remove, folder, os.getpid())
    return folder


def clear(spark: SparkSession) -> None:
    """Removes what this application has written; its results end with it."""
    _remove(session_folder(spark), os.getpid())


def _remove(folder: str, owner: int) -> None:
    if os.getpid() != owner:  # a forked worker ends
        return
    if folder.startswith("file:") or folder.startswith("/"):
        shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)
    except Exception:  # the driver ends either way; the folder is named by the application
        pass
