"""Arrow-batched row functions: the one place where rows cross into Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Bytes of a batch that a function sees at once; longer batches are cut by rows, so long texts don't add up in memory.
BATCH_BYTES = 32 << 20


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BATCH_BYTES``, at least a row each."""
    if b.num_rows:
        step = max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


_MOVES = re.compile(r"\b(?:Join|Aggregate|Sort|Window|Repartition|Union|Generate|Distinct|Intersect|Except|MapInArrow|MapInPandas|LocalLimit|GlobalLimit|Deduplicate)")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan over all cores where its files give fewer tasks than there are cores.

    A table of one small file is one task, however much work its rows are. Tables with tasks for
    every core, and plans that already move rows, are returned as they are, so nothing is shuffled at scale.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    if _MOVES.search(plan.optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType, setup: Callable | None = None) -> DataFrame:
    """Apply ``fn(batch, state)`` to each Arrow batch; ``fn`` returns a dict of column lists.

    ``setup()`` runs once per task and its result is passed as ``state``.
    """
    st = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            for piece in pieces(b):
                out = fn(piece, state)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return spread(df).mapInArrow(run, st)
