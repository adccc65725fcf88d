"""Making the package importable for the Python workers of a session."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's files to the executors, once per application.

    Where they can import it already (an installed package, PYTHONPATH) this changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith((".py", ".npz")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    place = tempfile.mkdtemp(prefix="textquarry-")  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    file = os.path.join(place, "textquarry.zip")
    with open(file, "wb") as f:
        f.write(body.getvalue())
    context.addPyFile(file)
    _shipped.add(context.applicationId)
