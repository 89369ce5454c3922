"""Versioned keys of computed stages, and the split into what is known and what must be computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stage_key(stage: str, payload: Column, versions: dict[str, str], configuration: dict[str, str] | None = None) -> Column:
    """SHA-256 over stage, input digest, versions and configuration, in sorted order."""
    fixed = ";".join(f"{k}={v}" for part in (versions, configuration or {}) for k, v in sorted(part.items()))
    return F.sha2(F.concat_ws("|", F.lit(stage), F.sha2(payload, 256), F.lit(fixed)), 256)


def hits(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``work`` whose cache_key is known, with the stored payload."""
    return work.join(cache.select("cache_key", "payload").dropDuplicates(["cache_key"]), "cache_key")


def misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``work`` that must be computed, each key once."""
    return work.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def cached_stage(work: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """Stored results and, for misses only, those of ``compute``: a function from misses to (cache_key, payload)."""
    fresh = compute(misses(work, cache)).select("cache_key", "payload")
    known = cache.select("cache_key", "payload").unionByName(fresh).dropDuplicates(["cache_key"])
    return work.join(known, "cache_key")


def cache_stats(work: DataFrame, cache: DataFrame) -> DataFrame:
    """(chunks, hits, misses) over all of ``work``."""
    known = work.join(cache.select("cache_key", F.lit(1).alias("known")).dropDuplicates(["cache_key"]), "cache_key", "left")
    return known.agg(F.count("*").alias("chunks"), F.count("known").alias("hits"), (F.count("*") - F.count("known")).alias("misses"))


def file_fingerprints(spark, path: str) -> DataFrame:
    """(path, fingerprint): SHA-256 of the bytes of each file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("fingerprint"))


def folder_fingerprint(spark, path: str) -> DataFrame:
    """(fingerprint) of a folder: SHA-256 over path, length and time of change of its files, in order; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    rows = F.array_sort(F.collect_list(F.struct("path", "length", "at")))
    return files.agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"))


def without(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A cache without the given cache_keys, or an empty one."""
    return cache.limit(0) if keys is None else cache.join(keys.select("cache_key"), "cache_key", "left_anti")


def latest_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events (at, stage, hit, detail): what a cache's log shows."""
    return events.orderBy(F.desc("at")).limit(n)


def stage_times(events: DataFrame) -> DataFrame:
    """(stage, n, seconds, hits) over the runs (stage, seconds, hit); a hit takes no time."""
    took = F.when(F.col("hit"), 0.0).otherwise(F.coalesce("seconds", F.lit(0.0)))
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.sum(took).alias("seconds"), F.count_if("hit").alias("hits"))
