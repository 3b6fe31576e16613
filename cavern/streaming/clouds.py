"""Homology of the clouds that arrive in a stream's micro-batches; an extension, not part of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.homology import compute_persistent_homology


def write_pairs(stream: DataFrame, path: str, checkpoint: str, max_dim: int, key: str = "id", **options):
    """Starts a query that appends (batch, dim, birth, death) of each micro-batch's cloud to Parquet."""

    def each(batch: DataFrame, batch_id: int) -> None:
        found = compute_persistent_homology(batch, max_dim, key=key, **options)
        found.pairs.select(F.lit(batch_id).alias("batch"), "dim", "birth", "death").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
