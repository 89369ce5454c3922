"""JSON lines, RTTM, reports and audits as files; results that a resumed run adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meetspark.operators.corpora import pending, rttm_lines


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Write rows as JSON lines in UTF-8, nulls kept as such, and return how many there are."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def write_rttm(segments: DataFrame, path: str) -> None:
    """One folder per meeting of RTTM lines in order of time; segments without a positive duration are left out."""
    lines = rttm_lines(segments).withColumn("meeting", F.split("line", " ")[1]).withColumn("at", F.split("line", " ")[3].cast("double"))
    lines.repartition("meeting").sortWithinPartitions("meeting", "at").select("meeting", "line").write.mode("overwrite").partitionBy("meeting").text(path)


def write_reports(reports: DataFrame, path: str, text: str = "report") -> None:
    """One folder per meeting that holds its report as text."""
    reports.select(F.col("meeting_id").alias("meeting"), F.col(text).alias("line")).write.mode("overwrite").option("lineSep", "\n").partitionBy("meeting").text(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """The rows of an audit, few by nature, as one JSON file."""
    audit.coalesce(1).write.mode("overwrite").json(path)


def append_pending(work: DataFrame, compute, path: str, key: str, schema: str) -> DataFrame:
    """Add the results of ``compute`` for the keys that ``path`` doesn't hold yet, and return all of them.

    A run that was stopped goes on where it ended: what lies in ``path`` is never
    computed again. ``compute`` is a function from pending rows to (key, ...).
    """
    spark = work.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    todo = pending(work, spark.read.schema(schema).json(path), key) if exists else work
    compute(todo).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)
