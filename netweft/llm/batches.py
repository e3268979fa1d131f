"""Reading Arrow batches in pieces of bounded size."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of an Arrow batch; texts are whole, so many of them are large.
ROWS = 500
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches have at most ROWS rows."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_KEY)) <= ROWS:
        conf.set(_ROWS_KEY, ROWS)
    return df


def keyed_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just (key long, text string); a null text is empty. All other columns stay behind, whatever their names."""
    return bounded(df).select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, so that what is built from a slice stays bounded too.

    A worker waits for other tasks when this one is done, so what Arrow then holds without need is given back.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
    pa.default_memory_pool().release_unused()


def merged(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``limit`` bytes or a little more, for work that is done once for what a batch has in common."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= limit:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """(key, text) of the n ids with the smallest hash, each with the smallest of its texts: the same ones however the table is dealt out.

    The rows are counted first, so that only about 2 n of them, and all rows of the same ids, pass a threshold of the hash
    and leave their tasks; repeated ids are made one within each task.
    """
    total = rows.count()
    low = rows.withColumn("h", F.xxhash64("key"))
    if total > 2 * n:
        low = low.where(F.col("h") < -(1 << 63) + (2 * n << 64) // total)
    return low.groupBy("h", "key").agg(F.min("text").alias("text")).orderBy("h", "key").limit(n).select("key", "text")
