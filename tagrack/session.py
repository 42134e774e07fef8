"""SparkSession construction and the shared checkpoint folder.

On a cluster the session is built by the launcher and already carries
``spark.checkpoint.dir`` (a folder every executor can reach). Only when
that setting is missing -- local runs and tests -- do we make one ourselves.
"""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import SparkSession

# Settings every job relies on; a cluster launcher may override sizes.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    # pandas deprecation notices from inside PySpark's Arrow serializer
    "spark.executorEnv.PYTHONWARNINGS": "ignore::FutureWarning",
}


def build_session(master: str | None = None, app: str = "tagrack",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Parent folder of everything written for one application, by application id.
_parents: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Named by ``spark.checkpoint.dir``; failing that, the folder the launcher
    gave to ``setCheckpointDir``; failing that, and only on a local master, a
    private temporary folder. The answer is fixed per application, so the path
    of later checkpoints never grows, and ``setCheckpointDir`` is called once.
    """
    sc = spark.sparkContext
    known = _parents.get(sc.applicationId)
    if known:
        return known
    path = spark.conf.get("spark.checkpoint.dir", None)
    have = sc.getCheckpointDir()
    if not path and have:
        path = have.rsplit("/", 1)[0]  # Spark appends its own sub-folder
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at storage every "
                               "executor can reach (a machine-local folder would lose data)")
        path = tempfile.mkdtemp(prefix="tagrack-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not have:
        sc.setCheckpointDir(path)
    _parents[sc.applicationId] = path
    return path


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables.

    They lie under the application's own folder, which goes when Python ends
    (``drop_scratch`` removes it earlier).
    """
    root = _scratch_root(spark)
    if root not in _scratch_roots:
        _scratch_roots.add(root)
        atexit.register(_remove, root)
    return f"{root}/{name}-{os.getpid()}-{next(_counter)}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application's queries have written between their steps.
    Only when none of their results is still to be read."""
    _remove(_scratch_root(spark))


def _remove(path: str) -> None:
    """Delete a folder on whatever file system it lies; a JVM that has gone is left alone."""
    jvm = SparkContext._jvm
    if jvm is None:
        return
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
    except (Py4JError, OSError):  # the application is ending; the cluster's own cleaning takes the rest
        pass


_counter = itertools.count(1)
_scratch_roots: set[str] = set()
