"""Bounded packing of rendered lines into chunks, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def pack(sizes: list[int], limit: int) -> list[int]:
    """Chunk number of each piece: greedy, in order, one more character between pieces of a chunk."""
    out, chunk, used = [], 0, 0
    for size in sizes:
        if used and used + 1 + size > limit:
            chunk, used = chunk + 1, 0
        used += size + (1 if used else 0)
        out.append(chunk)
    return out


def chunk_lines(lines: DataFrame, limit: int, key: str = "meeting_id", text: str = "rendered") -> DataFrame:
    """(key, idx, part, chunk, piece): every line in its chunk; lines over ``limit`` are cut hard first.

    Only sizes go through the greedy walk, which depends on what came before;
    it sees one meeting at a time, as arrays of two numbers a line.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / limit), F.lit(0)).cast("int"))
    pieces = lines.where(F.length(text) > 0).select(key, "idx", text, F.explode(starts).alias("part"))
    pieces = pieces.withColumn("piece", F.substring(text, F.col("part") * limit + 1, F.lit(limit))).drop(text)
    order = F.array_sort(F.collect_list(F.struct("idx", "part", F.length("piece").alias("size"))))
    groups = pieces.groupBy(key).agg(order.alias("pieces"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "chunks": [pack([p["size"] for p in ps], limit) for ps in batch["pieces"]], "pieces": batch["pieces"]})

    kind = dict(groups.dtypes)[key]
    numbered = groups.mapInPandas(number, f"{key} {kind}, chunks array<int>, pieces array<struct<idx:int,part:int,size:int>>")
    placed = numbered.select(key, F.explode(F.arrays_zip("pieces", "chunks")).alias("z")).select(key, "z.pieces.idx", "z.pieces.part", F.col("z.chunks").alias("chunk"))
    return placed.join(pieces, [key, "idx", "part"])


def chunks(lines: DataFrame, limit: int, key: str = "meeting_id", text: str = "rendered") -> DataFrame:
    """(key, chunk, n_lines, text) of each chunk."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "part", "piece")))
    joined = F.array_join(F.transform(rows, lambda r: r["piece"]), "\n")
    return chunk_lines(lines, limit, key, text).groupBy(key, "chunk").agg(F.count("*").alias("n_lines"), joined.alias("text"))
