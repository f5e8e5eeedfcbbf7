"""Training-order materialisation of token ids in fixed-stride binary shards.

Each input partition is one stream of ids (every document and an end id), cut into sequences of ``length`` ids; only the
last sequence of a partition is padded. Texts are encoded once: the sequences go to the shared folder in packs of
``FLUSH`` records, and what Spark has committed there is counted. Prefix sums of the partitions' counts
give every sequence a global number, and a keyed Feistel permutation with cycle walking gives the number
its slot. Shard ``k`` holds slots ``[k * slots, (k + 1) * slots)`` in order, one record each of the same size, so slot
``s`` begins at byte ``(s % slots) * stride`` of its shard and a reader can resume anywhere. Range partitions of whole
shards write them; their bounds follow from the number of sequences, so nothing is sampled.

A record is the id of the first id's document (int64), the number of that document's ids before it (uint32), the number of ids (uint16), the
ids (uint16, padded with zeros), and a line feed, which Spark's text writer adds. A lost task of the second pass
reads the committed packs again, so it cannot meet other rows or another order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vec
from .common import materialize, shared_path
from .sharding import PRIME, ROUNDS, radices, round_keys
from .tokens import encoder, with_end

LENGTH, SLOTS = 1024, 8192
FLUSH = 1024
#: Bytes of text that a task encodes at once.
ENCODE_BYTES = 1 << 20
#: Most range partitions that write; beyond as many shards, each writes a run of shards.
MOST_RANGES = 20_000
#: Compression of what goes through the shared folder and the shuffle, which with the shards make up the disk.
LEVEL = 6


def permute_array(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``sharding.permute_number`` for an array of numbers."""
    a, b = radices(n)
    keys = round_keys(seed)
    out, live = x.astype(np.int64), np.arange(len(x))
    while len(live):
        left, right = out[live] // b, out[live] % b
        for r in range(ROUNDS):
            m, c, d = keys[r]
            t = ((left if r % 2 else right) * m + c) % PRIME
            v = (t * t % PRIME * t + d) % PRIME
            left, right = (left, (right + v) % b) if r % 2 else ((left + v) % a, right)
        out[live] = left * b + right
        live = live[out[live] >= n]
    return out


def record_type(length: int = LENGTH) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("start", "<u4"), ("n", "<u2"), ("ids", "<u2", (length,))])


def _sequences(batches: Iterator[pa.RecordBatch], length: int, end_id: int) -> Iterator[np.ndarray]:
    """Records of a partition's stream, a few at a time."""
    encode = encoder().encode_block
    ids, docs, starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def records(n: int) -> np.ndarray:
        out = np.zeros(-(-n // length), record_type(length))
        at = np.arange(len(out)) * length
        if ids[:n].max() > 0xFFFF or starts[at].max() > 0xFFFFFFFF:
            raise ValueError("an id or a place in a text is too large for a record")
        out["doc_id"], out["start"], out["n"] = docs[at], starts[at], np.minimum(n - at, length)
        flat = np.zeros(len(out) * length, "<u2")
        flat[:n] = ids[:n]
        out["ids"] = flat.reshape(-1, length)
        return out

    for batch in batches:
        doc_ids = batch.column(0).fill_null(-1).to_numpy()
        for begin, _, buf, offs in vec.text_blocks(batch.column(1), ENCODE_BYTES):
            new, first = with_end(*encode(buf, offs), end_id)
            size = np.diff(first)
            ids = np.concatenate((ids, new))
            docs = np.concatenate((docs, np.repeat(doc_ids[begin : begin + len(size)], size)))
            starts = np.concatenate((starts, np.arange(len(new)) - np.repeat(first[:-1], size)))
            n = len(ids) // length * length
            if n:
                yield records(n)
                ids, docs, starts = ids[n:], docs[n:], starts[n:]
    if len(ids):
        yield records(len(ids))


def _packed(press: zstandard.ZstdCompressor, rows: np.ndarray) -> bytes:
    return press.compress(rows.tobytes())


def _unpacked(pack: bytes, length: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(pack), record_type(length))


def encoded_sequences(narrow: DataFrame, length: int, end_id: int) -> DataFrame:
    """(part, at, n, pack): packs of records of each partition's stream, and the number of records before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(LEVEL)
        for rows in _flushed(_sequences(batches, length, end_id)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([_packed(press, rows)], pa.binary())], ["part", "at", "n", "pack"])
            at += len(rows)

    return narrow.mapInArrow(run, "part int, at long, n long, pack binary")


def _flushed(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same records, at least ``FLUSH`` at a time."""
    held: list[np.ndarray] = []
    for rows in parts:
        held.append(rows)
        if sum(map(len, held)) >= FLUSH:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, slots: int = SLOTS, end_id: int = 0, seed: int = 13, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write all sequences of ``docs`` to ``path``/shard=k; returns their number.

    Null and empty texts give an end id alone; a null id is written as -1; repeated rows are written as often as they occur; an
    empty table gives no shard; other columns are ignored. An id of 65536 or more, or a text of 2**32 ids, raises an error.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = materialize(encoded_sequences(narrow, length, end_id), "sequences", row_group=8 << 20)
    counts = encoded.groupBy("part").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # one row for each input partition: as few as there are tasks
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = encoded.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("number"), "pack")
    shards = max(1, -(-total // slots))
    per_range = -(-shards // MOST_RANGES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(LEVEL)
        for batch in batches:
            for number, pack in zip(batch.column("number").to_pylist(), batch.column("pack"), strict=True):
                rows = _unpacked(pack.as_py(), length)
                slot = permute_array(np.arange(number, number + len(rows)), total, seed)
                order = np.argsort(slot)
                span = slot[order] // (slots * per_range)
                first = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1])))
                cut = list(zip(first, np.append(first[1:], len(order)), strict=True))
                places = [slot[order[a:b]].astype("<i8").tobytes() for a, b in cut]
                packs = [_packed(press, rows[order[a:b]]) for a, b in cut]
                yield pa.RecordBatch.from_arrays([pa.array(span[first], pa.int32()), pa.array(places, pa.binary()), pa.array(packs, pa.binary())], ["span", "slots", "pack"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, pack in zip(batch.column("slots"), batch.column("pack"), strict=True):
                slot, rows = np.frombuffer(places.as_py(), "<i8"), _unpacked(pack.as_py(), length)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(slot // slots), pa.array(slot), raw.cast(pa.binary())], ["shard", "slot", "record"])

    sent = numbered.mapInArrow(send, "span int, slots binary, pack binary").repartitionById(-(-shards // per_range), "span")
    placed = sent.select("slots", "pack").mapInArrow(place, "shard long, slot long, record binary")
    # the text source takes strings; the cast keeps the bytes as they are
    ordered = placed.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
    ordered.write.partitionBy("shard").option("maxRecordsPerFile", 0).text(path)
    return total


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, slots: int = SLOTS, with_ids: bool = True) -> DataFrame:
    """(slot, shard, doc_id, start, n_ids, ids_crc32[, ids]) of each record; a shard of a broken size raises an error.

    A shard is one file: the writer's range partitions hold whole shards, and it is told not to split files.
    """
    size = record_type(length).itemsize + 1
    kind = np.dtype([("r", record_type(length)), ("end", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                if len(raw) % size or len(raw) > slots * size:
                    raise ValueError(f"shard {shard} has {len(raw)} bytes, no multiple of {size} up to {slots} times")
                whole = np.frombuffer(raw, kind)["r"]
                for at in range(0, len(whole), FLUSH):
                    rows = whole[at : at + FLUSH]
                    ids = [r["ids"][: r["n"]].astype("<u4").tobytes() for r in rows]
                    arrays = [pa.array(shard * slots + at + np.arange(len(rows))), pa.array(np.full(len(rows), shard)), pa.array(rows["doc_id"].astype(np.int64)), pa.array(rows["start"].astype(np.int64)), pa.array(rows["n"].astype(np.int64)), pa.array(map(zlib.crc32, ids), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.binary())] if with_ids else [])], ["slot", "shard", "doc_id", "start", "n_ids", "ids_crc32"] + ["ids"] * with_ids)

    schema = "slot long, shard long, doc_id long, start long, n_ids long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").load(path).withColumn("shard", F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long"))
    return files.select("shard", "content").mapInArrow(run, schema)


def materialize_order(docs: DataFrame, length: int = LENGTH, slots: int = SLOTS, seed: int = 13) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back: a row for each slot. Nulls, repeated rows and other columns: see ``write_shards``."""
    path = shared_path(docs.sparkSession, "shards")
    write_shards(docs, path, length, slots, seed=seed)
    return read_shards(docs.sparkSession, path, length, slots, with_ids=False)
