"""Makes this package importable in the Python workers of a session, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Local workers get the folder on their path; executors elsewhere get the package as a zip from Spark, unless their path
    names the folder already. Once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    _SENT.add(sc.applicationId)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if sc.master.startswith("local[") or sc.master == "local":
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), sc.environment.get("PYTHONPATH", "")]))
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(target)


def initialize_numerics_runtime(spark: SparkSession, threads: int = 1) -> None:
    """Kernels in Python workers take `threads` threads each, so that tasks, of which there is one a core, don't crowd each other
    out. For workers that start from now on."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ[name] = str(threads)
        spark.sparkContext.environment[name] = str(threads)
