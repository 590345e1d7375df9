"""Lets Python workers on any machine import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Puts the package on the path of the session's workers; where they may run on other machines, sends it as an archive."""
    sc = spark.sparkContext
    env = sc.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if not is_local(spark) and sc.applicationId not in _sent:
        sc.addPyFile(_archive())
        _sent.add(sc.applicationId)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and workers are one process on one machine (master local or local[n])."""
    return spark.sparkContext.master.split("[")[0] == "local"


def _archive() -> str:
    """The package's modules as a zip file in the driver's temporary folder."""
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "fibrion.zip")
    top = os.path.join(ROOT, "fibrion")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    return path
