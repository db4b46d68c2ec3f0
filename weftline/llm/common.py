"""Helpers shared by the training-data operators: shared storage, input columns, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import shared_path, stored  # noqa: F401

#: UTF-8 bytes that one numpy pass takes at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


#: Bytes a core up to which a table of few parts is spread.
SPREAD_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A small table on all cores: files of one row group each are parts that can't be split.

    Only where a scan (and nothing but a scan) has no more parts than there are cores, and SPREAD_BYTES a core at most,
    which bounds what is shuffled; other tables are as they were.
    """
    cores, plan = scan.sparkSession.sparkContext.defaultParallelism, scan._jdf.queryExecution()
    few = plan.toRdd().getNumPartitions() <= cores
    return scan.repartition(cores) if few and int(str(plan.optimizedPlan().stats().sizeInBytes())) <= cores * SPREAD_BYTES else scan


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, by fixed names; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, the name or, where df has such a column (in any case), one that it doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def blocks(batch: pa.RecordBatch, column: int, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about max_bytes together, and one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.diff(text_buffer(batch.column(column))[1])
    part = (np.cumsum(lengths) - lengths) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets from 0) of a string array without nulls, not copied."""
    wide = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS texts at most, unless the session asks for fewer: they are held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text_column: int = 1) -> DataFrame:
    """df through Python by Arrow: make() once a task gives a function from a block of rows to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in blocks(batch, text_column):
                out = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def by_text(make: Callable[[], Callable[[pa.Array], list]], returns: str, max_bytes: int = BLOCK_BYTES):
    """A column function of texts by Arrow: make() gives a function from an array without nulls to its results."""

    @F.arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        work = make()
        if texts.null_count:
            texts = texts.fill_null("")
        out: list = []
        for part in blocks(pa.RecordBatch.from_arrays([texts], ["text"]), 0, max_bytes):
            out += work(part.column(0))
        return pa.array(out, kind)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(returns))
    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal leading n_keys columns in a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(n_keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(batch.column(k)[a].as_py() for k in range(n_keys))
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


#: Bits of the marks of a set of keys at most (as rows of 64, a broadcast of some 20 MB), and bits a key.
MOST_MARK_BITS, MARK_BITS = 1 << 25, 16
#: A key is hot if it has more than this part of all rows; so there are at most as many hot keys.
HOT_PART = 10_000


def sift(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose column may be in keys, which has the same column; those whose surely isn't). No row is shuffled.

    Marks of the keys' hashes are broadcast: a table of bounded size, however many keys there are. The more there
    are beyond its size, the more rows may be: what is exact has to follow.
    """
    mark, bits, at = unused(df, "mark", "bits", "at")
    n_words = max(16, min(MOST_MARK_BITS, 1 << (MARK_BITS * keys.count()).bit_length()) // 64)
    place = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(n_words))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST(xxhash64(`{c}`) & 63 AS INT))")
    marks = keys.groupBy(place(column).alias(at)).agg(F.bit_or(bit(column)).alias(bits))
    told = df.join(F.broadcast(marks), place(F.col(column)) == F.col(at), "left")
    told = told.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(bit(column)) != 0, F.lit(False)))
    names = [f"`{c}`" for c in df.columns]
    return told.filter(F.col(mark)).select(*names), told.filter(~F.col(mark)).select(*names)


def join_hot(df: DataFrame, sizes: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """df joined (inner or left) with sizes (unique keys, and how many rows of df have each; stored) on key.

    Hot keys, of which there are at most HOT_PART, are broadcast, so that their rows stay where they are; only the
    rows of the others are shuffled.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > F.lit(max(total // HOT_PART, 1000))
    few = F.broadcast(sizes.filter(hot))
    rest = df.join(F.broadcast(sizes.filter(hot).select(key)), key, "left_anti")
    return df.join(few, key).unionByName(rest.join(sizes.filter(~hot), key, how))


#: Rows that are numbered in one go; a power of two.
CHUNK_ROWS = 1 << 16


def numbered_chunks(df: DataFrame, chunk: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """df with a column that numbers its chunks of at most so many rows, equal or not. To be stored before it's used."""
    return df.withColumn(chunk, F.shiftright(F.monotonically_increasing_id(), rows.bit_length() - 1))


def with_slots(df: DataFrame, keys: list[str], order: list[str], slot: str, chunk: str) -> DataFrame:
    """df (stored, with numbered_chunks) with a gapless number from 0 within keys, however many rows share a key.

    Rows are numbered within (keys, chunk) by the order columns and start where the chunks before theirs end, so
    that a hot key, and rows that are all equal, are spread over as many tasks as they need. Chunk sums are
    pre-aggregated; they number at most keys x chunks. The chunk's column goes.
    """
    from pyspark.sql import Window

    start, n_rows = unused(df, "start", "n_rows")
    counts = df.groupBy(*keys, chunk).agg(F.count("*").alias(n_rows))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(n_rows).over(before), F.lit(0))).drop(n_rows)
    within = Window.partitionBy(*keys, chunk).orderBy(*order)
    ranked = df.withColumn(slot, F.row_number().over(within) - 1)
    return ranked.join(starts, [*keys, chunk]).withColumn(slot, (F.col(slot) + F.col(start)).cast("long")).drop(chunk, start)
