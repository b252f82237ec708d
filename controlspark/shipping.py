"""Makes this package importable in the Python workers of a session, wherever they run."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def on_one_machine(spark: SparkSession) -> bool:
    """Whether the executors are threads of the driver, so that all see its folders."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def ship(spark: SparkSession) -> SparkSession:
    """Workers on the driver's machine get its import path; others get the package as an archive, once a session."""
    sc = spark.sparkContext
    if on_one_machine(spark):
        now = sc.environment.get("PYTHONPATH", "")
        if str(ROOT) not in now.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), now) if x)
    elif sc.applicationId not in _sent:
        _sent.add(sc.applicationId)
        name = Path(tempfile.mkdtemp()) / "controlspark.zip"  # served by the driver; no executor opens this path
        with zipfile.ZipFile(name, "w") as archive:
            for path in sorted(ROOT.glob("controlspark/**/*.py")):
                archive.write(path, path.relative_to(ROOT))
        sc.addPyFile(str(name))
    return spark
