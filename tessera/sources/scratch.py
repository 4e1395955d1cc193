"""A place for stores that a query makes for itself."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = Path(tempfile.mkdtemp(prefix="tessera-")).as_uri()
    return f"{shared.rstrip('/')}/stores/{uuid.uuid4().hex}"
