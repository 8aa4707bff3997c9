"""Dense 0-based positions in a global order without a single-partition window.

Only the order keys are numbered: they are range-partitioned (sampled
bounds), sorted inside each partition and tagged with
``monotonically_increasing_id`` (partition index in the high bits, row index
in the low 33 bits). That small key table is written once to the shared
checkpoint folder, so the per-partition counts and the numbering read the
same rows even if a sampling or a task is repeated. Each key is shifted by
the row count of all earlier partitions (one row per partition, broadcast)
and the positions are joined back on the keys. The order keys must be
unique (equal ones raise): pass a unique key as the last order column.

``numbered_in_groups`` numbers whole rows within groups: the one range
exchange by group and order that sorts them also carries their other columns,
and a group that runs over several partitions goes on counting by one figure
per partition, so nothing is joined back and no group is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from bowline.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def dense_positions(df: DataFrame, order_cols: list[str], name: str = "pos",
                    partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = materialize(
        df.select(*order_cols).repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    if not tagged.groupBy(*order_cols).count().filter("count > 1").isEmpty():
        raise ValueError(f"order keys are not unique: {', '.join(order_cols)}")
    part = F.shiftright("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part")
                                    .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    keys = [f"_k{i}" for i in range(len(order_cols))]
    pos = (tagged.withColumn("_part", part)
           .join(F.broadcast(offsets), "_part")
           .select(*[F.col(c).alias(k) for c, k in zip(order_cols, keys)],
                   (F.col("_off") + local).cast("long").alias(name)))
    # null-safe equality: rows with NULL keys keep their position too
    cond = [df[c].eqNullSafe(pos[k]) for c, k in zip(order_cols, keys)]
    return df.join(pos, cond).drop(*keys)


def _differs(batch: pa.RecordBatch, columns: list[int], before: list) -> np.ndarray:
    """Whether each row differs in some of the columns from the row before it (nulls are equal)."""
    out = np.zeros(batch.num_rows, np.bool_)
    for i, last in zip(columns, before or [None] * len(columns)):
        col = batch.column(i)
        a, b = col.slice(1), col.slice(0, batch.num_rows - 1)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        out[1:] |= ~pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)
        out[0] |= before is None or col[0].as_py() != last
    return out


def _number(group: int, order: list[int]):
    """Add (_part, _run, _at, _same): the group's run in the partition, the place in it, and a repeated key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, runs, count = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _differs(batch, [group], before and before[:1])
            same = ~(new | _differs(batch, order, before and before[1:]))
            starts = np.flatnonzero(new)
            at = np.arange(n) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [n]])))
            at[:starts[0] if len(starts) else n] += count
            run_of = runs + np.cumsum(new)
            runs, count = int(run_of[-1]), int(at[-1]) + 1
            before = [batch.column(i)[n - 1].as_py() for i in (group, *order)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(run_of), pa.array(at), pa.array(same)],
                names=[*batch.schema.names, "_part", "_run", "_at", "_same"])
    return run


def numbered_in_groups(df: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with ``name``, their 0-based place in their group by the ``order`` columns (nulls first).

    The order must be unique in a group (equal keys raise). The result is written, so all that reads it
    sees the same numbers.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = df.columns.index
    schema = Ty.StructType([*df.schema.fields, Ty.StructField("_part", Ty.IntegerType()),
                            *[Ty.StructField(c, Ty.LongType()) for c in ("_run", "_at")],
                            Ty.StructField("_same", Ty.BooleanType())])
    local = materialize(
        df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
        .mapInArrow(_number(at(group), [at(c) for c in order]), schema), "numbered")
    parts = local.groupBy("_part").agg(
        F.max(F.when(F.col("_run") == 0, F.struct(F.col(group).alias("g")))).alias("first"),
        F.max(F.struct("_run", "_at", F.col(group).alias("g"))).alias("last"),
        F.max("_same").alias("same")).orderBy("_part").collect()
    if any(r["same"] for r in parts):
        raise ValueError(f"order keys are not unique: {', '.join([group, *order])}")
    carries, over, ended = [], 0, None
    for r in parts:
        carry = over if ended is not None and r["first"]["g"] == ended["g"] else 0
        if carry:
            carries.append((r["_part"], carry))
        ended = r["last"]
        over = r["last"]["_at"] + 1 + (carry if r["last"]["_run"] == 0 else 0)
    place = F.col("_at")
    if carries:
        local = local.join(F.broadcast(spark.createDataFrame(carries, "_part int, _carry long")), "_part", "left")
        place = place + F.when(F.col("_run") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0)
    kept = [c for c in df.columns if c != name]
    return local.select(*kept, place.cast("long").alias(name))
