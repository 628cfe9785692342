"""Shared folders, materialised steps and fixed-size tallies that several operators use."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A tally is summed in slices of this many counters, so that no task holds more than one slice per input row.
SLICE = 1 << 14


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor and the driver see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        made = spark.sparkContext.getCheckpointDir()
        if made is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            # One machine: its warehouse is as shared as anything.
            made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
            spark.sparkContext.setCheckpointDir(made)
            made = spark.sparkContext.getCheckpointDir()
        base = made
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps restart from the files."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the folders of frames made by ``stored`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tally(df: DataFrame, bits: int, buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each of ``2 ** bits`` buckets occurs in all batches of ``df``; the size is fixed, whatever the input.

    Each task counts for itself and sends slices, sparse or dense, that are summed by slice.
    """
    size = 1 << bits

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for values in buckets(batch):
                np.add.at(total, values, 1) if 16 * len(values) < size else np.add(total, np.bincount(values, minlength=size), out=total)
        ids, kinds, data = [], [], []
        for start in range(0, size, SLICE):
            part = total[start : start + SLICE]
            at = np.flatnonzero(part)
            if not len(at):
                continue
            dense = len(at) * 3 > len(part)
            ids.append(start // SLICE)
            kinds.append(dense)
            data.append(part.tobytes() if dense else at.astype("<u4").tobytes() + part[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.bool_()), pa.array(data, pa.binary())], ["slice", "dense", "data"])

    def add(batches):
        parts = {}
        for batch in batches:
            for at, dense, raw in zip(*[batch.column(c).to_pylist() for c in ("slice", "dense", "data")]):
                part = parts.setdefault(at, np.zeros(SLICE, np.int64))
                if dense:
                    part[: len(raw) // 8] += np.frombuffer(raw, "<i8")
                else:
                    n = len(raw) // 12
                    part[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["slice", "data"])

    sums = df.mapInArrow(count, "slice int, dense boolean, data binary").repartition("slice").mapInArrow(add, "slice int, data binary").collect()
    total = np.zeros(max(size, SLICE), np.int64)
    for row in sums:
        total[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["data"], "<i8")
    return total[:size]


# Marks of a filter are set in pieces of this many bits. A filter takes about so many bits a value, within these bounds.
PIECE = 1 << 17
BITS_PER_VALUE, LEAST_BITS, MOST_BITS = 32, 18, 25


def marks(df: DataFrame, column: str) -> np.ndarray:
    """A filter of a column of spread long values: packed bits at the values' low bits.

    Its size follows the number of values up to ``2 ** MOST_BITS`` bits (4 MB packed). Beyond that it lets more values
    through; what it lets through is settled by a join, so results do not depend on it.
    """
    values = df.select(F.col(column).alias("v"))
    n = values.count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (n * BITS_PER_VALUE).bit_length()))

    def cut(found: np.ndarray):
        """Rows of sorted distinct places, by piece."""
        edges = np.flatnonzero(np.diff(found // PIECE, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(found)]):
            piece = int(found[a]) // PIECE
            bits = np.zeros(PIECE, bool)
            bits[found[a:b] % PIECE] = True
            sparse = (b - a) * 32 < PIECE
            yield piece, not sparse, (found[a:b] % PIECE).astype("<u4").tobytes() if sparse else np.packbits(bits).tobytes()

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["piece", "dense", "data"])

    def collect(batches):
        held = np.zeros(size, bool)
        for batch in batches:
            held[batch.column("v").to_numpy() & (size - 1)] = True
        yield batch_of(list(cut(np.flatnonzero(held))))

    def merge(batches):
        pieces = {}
        for batch in batches:
            for piece, dense, raw in zip(*[batch.column(c).to_pylist() for c in ("piece", "dense", "data")]):
                bits = pieces.setdefault(piece, np.zeros(PIECE, bool))
                if dense:
                    bits |= np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
                else:
                    bits[np.frombuffer(raw, "<u4")] = True
        yield batch_of([(p, True, np.packbits(b).tobytes()) for p, b in pieces.items()])

    kind = "piece int, dense boolean, data binary"
    out = np.zeros(max(size, PIECE) // 8, np.uint8)
    for row in values.mapInArrow(collect, kind).repartition("piece").mapInArrow(merge, kind).collect():
        out[row["piece"] * PIECE // 8 : (row["piece"] + 1) * PIECE // 8] = np.frombuffer(row["data"], np.uint8)
    return out[: size // 8]


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a filter lets through."""
    at = values & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
