"""Exact dense top-k.

Queries are a stated set: they come in blocks of bounded size, each block is
broadcast and meets all vectors in one pass. A task multiplies small tiles and keeps
its k best for each query, so its memory is bounded by the block, and what is shuffled
grows with tasks x queries x k. Products are summed in double.

Odd cases: vectors that are null are skipped; a length that differs from the
queries' is an error; scores that aren't finite are dropped; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .best import BLOCK_SCORES, Best, key_array

BLOCK_BYTES = 8 << 20


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", decimals: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``vectors`` (key, vector), ``queries`` (query_id, vector) -> query_id, key, score, rank."""
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    size = asked.agg(F.sum(F.size("vector") * 8).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    # Sorted where they lie: a task meets its keys in order, and ties go to the smaller one.
    rows = vectors.where(F.col("vector").isNotNull()).select(key, F.col("vector").cast("array<double>").alias("vector")).sortWithinPartitions(key)
    ids = f"query_id {asked.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}"
    found = None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if not own.num_rows:
            continue
        part = _block(rows, own, k, key, decimals, ids)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{ids}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int | None, message: str) -> np.ndarray:
    """Vectors as rows; ``width``: of each, by default the first one's."""
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes[0]) if width is None else width
    if (sizes != width).any():
        raise ValueError(message)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _block(rows: DataFrame, own: pa.Table, k: int, key: str, decimals: int, ids: str) -> DataFrame:
    own = own.combine_chunks()
    matrix = _matrix(own.column("vector").chunk(0), None, "query vectors differ in length")
    sent = rows.sparkSession.sparkContext.broadcast((own.column("query_id").chunk(0), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        best, kind = Best(len(q), k, decimals), None
        tile, step = 256, BLOCK_SCORES // 256
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                kind, keys = b.schema.field(key).type, key_array(b.column(key))
                v = _matrix(b.column("vector"), q.shape[1], "stored vectors and query vectors differ in length").T
                for i in range(0, len(q), tile):
                    best.update(q[i : i + tile] @ v, keys, i)
                best.next_rows(len(keys))
        for columns in best.rows(names, kind):
            yield pa.RecordBatch.from_arrays(columns, ["query_id", key, "score"])

    return rows.mapInArrow(run, f"{ids}, score double")
