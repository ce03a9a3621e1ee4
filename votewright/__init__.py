"""votewright: programmatic training-data labelling on PySpark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"


def ship(spark) -> None:
    """Makes the package importable in Python workers, whatever folder the driver was started in.

    Workers on the driver's machine get its path; to those of a cluster a zip of
    the sources is sent, once for each context. Not needed where the package is installed.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.master.startswith("local"):
        paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
        if str(root.parent) not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([str(root.parent), *filter(None, paths)])
    elif not getattr(context, "_votewright_shipped", False):
        path = Path(tempfile.mkdtemp()) / "votewright.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        context._votewright_shipped = True
