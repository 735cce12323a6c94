"""Where queries write on their way: a folder that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: What opening a file counts for when files are dealt over tasks, in place of the default's 4 MB, by
#: which a task gets 31 small archives and a folder of a million 32,000 tasks.
OPEN_COST = "spark.sql.files.openCostInBytes"
OPEN_BYTES, DEFAULT_BYTES = 256 << 10, 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once for each application; small files are read
    many to a task, unless the session says otherwise."""
    sc = spark.sparkContext
    if spark.conf.get(OPEN_COST) in (str(DEFAULT_BYTES), f"{DEFAULT_BYTES}b", "4MB"):
        spark.conf.set(OPEN_COST, str(OPEN_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(), "kinetable_core.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may go without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A place in that folder that nothing else uses."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
