"""Sessions with the settings that the library is tuned for, and a description of one."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import SparkNoSuchElementException
from pyspark.sql import SparkSession


def get_session(app: str = "lexigrain", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def describe_session(spark: SparkSession) -> dict[str, str | None]:
    """Batch size, target partitions and time zone; None where a setting has no value."""
    keys = {"batch_size": "spark.sql.parquet.columnarReaderBatchSize", "target_partitions": "spark.sql.shuffle.partitions", "time_zone": "spark.sql.session.timeZone"}
    def value(key: str) -> str | None:
        try:
            return spark.conf.get(key)  # the built-in one where none is set
        except SparkNoSuchElementException:
            return None

    return {name: value(key) for name, key in keys.items()}


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A temporary folder of this process, for sessions on one machine that name no checkpoint folder."""
    path = tempfile.mkdtemp(prefix="lexigrain-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Where that is unset, a session on one machine takes a temporary folder; on a cluster, whose machines would each
    have their own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/lexigrain-{uuid.uuid4().hex}"
