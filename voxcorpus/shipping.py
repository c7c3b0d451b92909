"""The package's own code on the workers."""

from __future__ import annotations

import atexit
from pathlib import Path
import shutil
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_lock = threading.Lock()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the executors of this application, once, so that Python workers find it
    wherever they were started. The driver serves the archive itself; no shared folder is needed."""
    context = spark.sparkContext
    with _lock:
        if context.applicationId in _shipped:
            return
        package = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="voxcorpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it as long as it runs
        archive = Path(folder) / "voxcorpus.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
