"""Tables that several queries use, written once per session under the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one. A local session that names none (as in tests) gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base or tempfile.mkdtemp(prefix='sparkfacet-')}/{uuid.uuid4().hex}"


def _state(spark: SparkSession, sf: str) -> str:
    """What the tables under sf are now: names, sizes and times of change of the files and folders there."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf}/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in found))


def _key(spark: SparkSession, sf: str, name: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, f"{sf}\n{_state(spark, sf)}", name


def is_stored(spark: SparkSession, sf: str, name: str) -> bool:
    return _key(spark, sf, name) in _PATHS


def stored(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name for the data under sf: made and written the first time, and again once the data changes."""
    key = _key(spark, sf, name)
    if key not in _PATHS:
        path = f"{shared_folder(spark)}-{name}"
        make().write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def forget(spark: SparkSession) -> None:
    """Delete the session's stored tables; those needed again are made anew."""
    own = [k for k in _PATHS if k[0] == spark.sparkContext.applicationId]
    for key in own:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(key))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
