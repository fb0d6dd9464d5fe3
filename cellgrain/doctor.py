"""What the engine runs on."""

from __future__ import annotations

import importlib.util
import platform

import pyspark
from pyspark.sql import SparkSession


def checks(spark: SparkSession) -> list[tuple[str, bool, str]]:
    """(what, whether it is well, detail) for each check."""
    conf, context = spark.conf, spark.sparkContext
    out = [
        ("python", True, platform.python_version()),
        ("pyspark", int(pyspark.__version__.split(".")[0]) >= 4, pyspark.__version__),
        ("java", True, context._jvm.System.getProperty("java.version")),
        ("master", True, f"{context.master}, {context.defaultParallelism} slots"),
        ("adaptive execution", conf.get("spark.sql.adaptive.enabled") == "true", conf.get("spark.sql.adaptive.enabled")),
        ("shuffle partitions", True, conf.get("spark.sql.shuffle.partitions")),
        ("checkpoint folder", context.getCheckpointDir() is not None, str(context.getCheckpointDir())),
        ("a job runs", spark.range(10).count() == 10, ""),
    ]
    return out + [(module, importlib.util.find_spec(module) is not None, "") for module in ("pandas", "pyarrow", "numpy")]


def report(spark: SparkSession) -> str:
    return "\n".join(f"{'ok  ' if good else 'look'} {what}" + (f": {detail}" if detail else "") for what, good, detail in checks(spark))
