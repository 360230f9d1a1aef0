"""SparkSession with the settings the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution on (partition counts, skewed joins); ``conf`` overrides, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
