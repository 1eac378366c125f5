"""Embedding tables as (id, vec): vectors packed as bytes, so that tasks read them as one matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, str, int]:
    """((id, vec) of the vectors that take part, numpy type of a component, components of a vector).

    Vectors that are null, empty or zero or hold null or non-finite components are left out, and so
    are those of another length than most (the shorter length on a tie), for which no measure is
    defined. Rows without id are left out.
    """
    kind = "<f4" if embeddings.schema[vector_column].dataType.elementType.typeName() == "float" else "<f8"
    rows = embeddings.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter("id is not null").filter(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = int(sizes["n"]) if sizes else 0
    rows = rows.filter(F.size("v") == dim)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            raw = [x.tobytes() for x in flat.reshape(b.num_rows, -1)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary"), kind, dim


def matrix(vectors, kind: str, dim: int) -> np.ndarray:
    """Rows of doubles from packed vectors."""
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(-1, dim).astype(np.float64)


def directions(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
