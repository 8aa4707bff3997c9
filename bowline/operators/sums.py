"""Sums of vectors by key.

Every task adds up the vectors of its own rows per key with NumPy, so the
shuffle gets one vector per key and batch and not one row per vector entry.
The vectors of a key are added up as they come, sorted by key, and are laid
out by dimension only then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def _batch_sums(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        n = len(keys.dictionary)
        at = pc.fill_null(keys.indices, n).to_numpy(zero_copy_only=False)  # null keys are one group
        order = np.argsort(at, kind="stable")
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        x = (x * batch.column(1).to_numpy(zero_copy_only=False)[:, None])[order]
        used, starts = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x, starts, axis=0)
        offsets = pa.array(np.arange(0, sums.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [keys.dictionary.take(pa.array(used, mask=used == n)),
             pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["key", "v"])


def _key_sums(batches):
    """Rows sorted by key -> one vector per key."""
    key = held = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(0)
        a, b = keys.slice(1), keys.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        starts = np.flatnonzero(np.append(True, ~same.to_numpy(zero_copy_only=False)))
        sums = np.add.reduceat(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), starts, axis=0)
        first = keys.slice(0, 1)
        if held is not None:
            if key.equals(first):
                sums[0] += held
            else:
                yield _rows(key, held[None])
        if len(starts) > 1:
            yield _rows(keys.take(pa.array(starts[:-1])), sums[:-1])
        key, held = pa.concat_arrays([keys.slice(int(starts[-1]), 1)]), sums[-1].copy()
    if held is not None:
        yield _rows(key, held[None])


def _rows(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(sums).ravel()))],
                                      names=["key", "v"])


def vector_sums(rows: DataFrame, key: str, vec: str, weight: Column | None = None) -> DataFrame:
    """(key, dim, x): the weighted sum of the vectors of every key, laid out by dimension."""
    kind = rows.schema[key].dataType
    schema = Ty.StructType([Ty.StructField("key", kind), Ty.StructField("v", Ty.ArrayType(Ty.DoubleType()))])
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return (rows.select(F.col(key).alias("key"), w.alias("w"), F.col(vec).cast("array<double>").alias("v"))
            .mapInArrow(_batch_sums, schema)
            .repartition("key").sortWithinPartitions("key").mapInArrow(_key_sums, schema)
            .select(F.col("key").alias(key), F.posexplode("v").alias("dim", "x")))
