"""Outlier analysis on Spark DataFrames: profile, clean, detect, combine, compare."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the session's Python workers (once per application).

    Not needed where it is installed on every node or passed with --py-files.
    """
    context = spark.sparkContext
    if getattr(context, "_fenceline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fenceline-py-"), "fenceline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("fenceline", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._fenceline_shipped = True
