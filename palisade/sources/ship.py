"""Getting the package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import palisade


def ship(spark: SparkSession) -> None:
    """Sends a zip of the package with the session's files, once per context.

    Workers import the package where ``PYTHONPATH`` names its folder or where it is
    installed; a session that has it on the driver's ``sys.path`` alone needs this.
    """
    package = os.path.dirname(os.path.realpath(palisade.__file__))
    home = os.path.dirname(package)
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if home in named or "site-packages" in home or getattr(sc, "_palisade_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="palisade-ship-")), "palisade_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, home))
    sc.addPyFile(path)
    sc._palisade_shipped = True
