"""Make this package importable in Python workers (what --py-files does)."""

from __future__ import annotations

import os
import shutil
import tempfile

_DONE: set[str] = set()


def ship_package(spark) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="fieldloom-ship-"), "fieldloom")
    sc.addPyFile(shutil.make_archive(base, "zip", root_dir=root, base_dir="fieldloom"))
    _DONE.add(sc.applicationId)
