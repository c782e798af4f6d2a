"""Files that executors write to and read from the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from quillgraph.plans.cut import shared_dir


def new_folder(spark: SparkSession, what: str) -> str:
    """The URI of a folder of its own in the shared folder."""
    return f"{re.sub('^file:/+', 'file:///', shared_dir(spark))}/{what}-{uuid.uuid4()}"


def opened(uri: str):
    """The file system of a URI or absolute path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
