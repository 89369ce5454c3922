"""Exact top-k by dot product of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Queries sent to executors at once; more are taken block by block.
BLOCK = 2_000


def top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """(q_id, vec_id, rank): the k rows with the largest dot product with each query, itself left out.

    ``queries``: q_id, q; ``vectors``: vec_id, embedding. Scores are rounded to
    ``digits``; of equal ones the smaller vec_id comes first. Every task keeps
    the k best of its batch, so k rows per query and batch are shuffled. Null
    vectors are left out.
    """
    rows = queries.where("q IS NOT NULL").orderBy("q_id").toPandas()  # the stated query set
    context = queries.sparkSession.sparkContext
    parts = []
    for at in range(0, max(1, len(rows)), BLOCK):
        block = rows.iloc[at : at + BLOCK]
        sent = context.broadcast((block["q_id"].to_numpy(), np.array(block["q"].tolist(), dtype=np.float64)))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                own = batch["vec_id"].to_numpy()
                scores = np.round(matrix @ np.array(batch["embedding"].tolist(), dtype=np.float64).T, digits)
                scores[ids[:, None] == own[None, :]] = -np.inf
                for q, row in zip(ids, scores):
                    best = np.lexsort((own, -row))[:k]
                    best = best[np.isfinite(row[best])]
                    yield pd.DataFrame({"q_id": q, "vec_id": own[best], "score": row[best]})

        parts.append(vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(scan, "q_id long, vec_id long, score double"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("q_id", "vec_id", "rank")
