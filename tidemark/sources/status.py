"""Sources apart from each other: each written with measures taken in passing, one that fails leaves the others alone."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidemark.tables import _hadoop

LOG = "run string, source string, ok boolean, rows long, bad long, newest string, reason string"


def ingest(spark: SparkSession, run: str, sources: dict[str, Callable[[SparkSession], DataFrame]], path: str, bad: Column, newest: Column) -> DataFrame:
    """The status rows of a run: (run, source, ok, rows, bad, newest, reason), after every source was written below ``path``.

    Rows, bad rows (where ``bad`` holds; they are not written) and the newest value are observed in the pass that writes;
    no source is read twice. A source that cannot be read or written has a status row with the reason and no rows; the
    others go on. Each source's folder is written under another name and renamed when it is whole, so that of a
    failed source the rows of the run before stay.
    """
    rows = []
    for name, read in sources.items():
        try:
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            df = read(spark)
            flagged = df.withColumn("_bad", F.coalesce(bad, F.lit(True)))
            watched = flagged.observe(seen, F.count("*").alias("rows"), F.count_if("_bad").alias("bad"), F.max(F.when(~F.col("_bad"), newest.cast("string"))).alias("newest"))
            watched.where(~F.col("_bad")).drop("_bad").write.mode("overwrite").parquet(f"{path}/.{name}-{run}")
            _replace(spark, f"{path}/.{name}-{run}", f"{path}/{name}")
            got = seen.get
            rows.append((run, name, True, got["rows"], got["bad"], got["newest"], None))
        except (PySparkException, Py4JJavaError) as e:  # the second when a task fails
            reason = e.getCondition() if isinstance(e, PySparkException) else str(e.java_exception.getMessage()).split("]")[0].strip("[")
            rows.append((run, name, False, 0, 0, None, reason or type(e).__name__))
    log(spark, f"{path}/log", run, rows)
    return spark.createDataFrame(rows, LOG)


def _replace(spark: SparkSession, new: str, old: str) -> None:
    fs, at = _hadoop(spark, old)
    fs.delete(at, True)
    fs.rename(_hadoop(spark, new)[1], at)


def log(spark: SparkSession, path: str, run: str, rows: list[tuple]) -> bool:
    """Adds a run's rows to a log by one rename; whether it was this call that added them.

    A run is one file that is named after it. It is written aside and renamed, which a file system does for one
    caller only: of two that log the same run at once one finds the name taken, and nothing is logged twice.
    """
    fs, folder = _hadoop(spark, path)
    fs.mkdirs(folder)
    done, part = _hadoop(spark, f"{path}/{run}.json")[1], _hadoop(spark, f"{path}/.{run}-{uuid.uuid4().hex}")[1]
    if fs.exists(done):
        return False
    out = fs.create(part, False)
    names = [f.split(" ")[0] for f in LOG.split(", ")]
    out.write("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows).encode())
    out.close()
    if fs.exists(done) or not fs.rename(part, done):
        fs.delete(part, False)
        return False
    return True


def logged(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log."""
    return spark.read.schema(LOG).json(path)
