"""What a session needs so that Python workers find this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_package(spark: SparkSession) -> SparkSession:
    """Workers that share the driver's files import from where the driver does; elsewhere --py-files ships the package."""
    spark.sparkContext.environment["PYTHONPATH"] = _ROOT
    return spark
