"""Packing of documents into fixed-length sequences.

Texts are tokenised and cut every ``length`` ids; only the last piece of a document is shorter. Pieces are
packed by first-fit decreasing, run on its own in randomised groups of at most about ``GROUP_PIECES`` pieces (group
= hash of the piece), so no task sees the whole corpus, and neither a very long document nor a row that is repeated
often fills a group. A tournament tree over the free room of the bins finds the leftmost bin with room in O(log bins).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .tokens import encoder, with_end

LENGTH = 1024
GROUP_PIECES = 4096


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy[, ids]): ids of each text and then ``end_id``, cut every ``length`` ids.

    copy tells equal rows of a task apart: 0 for the first row of an id and text, then 1, and so on, whatever the order of the rows.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, copy long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder().encode_block, Counter()
        for batch in batches:
            doc_ids = batch.column(0)
            keys = doc_ids.to_pylist()
            for begin, _, buf, offs in vec.text_blocks(batch.column(1)):
                ids, first = with_end(*encode(buf, offs), end_id)
                raw = ids.astype("<u4").tobytes()
                sizes = np.diff(first)
                n = -(-sizes // length)
                text = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(sizes[text] - start, length)
                at = (4 * (first[text] + start)).tolist()
                cut = [raw[a : a + 4 * s] for a, s in zip(at, size.tolist(), strict=True)]
                copies = np.zeros(len(sizes), np.int64)
                for i, (a, b) in enumerate(zip((4 * first[:-1]).tolist(), (4 * first[1:]).tolist(), strict=True)):
                    key = hash((keys[begin + i], zlib.crc32(raw[a:b]), b - a))
                    copies[i] = seen[key]
                    seen[key] += 1
                arrays = [doc_ids.take(pa.array(begin + text)), pa.array(start), pa.array(size), pa.array(map(zlib.crc32, cut), pa.int64()), pa.array(sizes[text]), pa.array(copies[text])]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cut, pa.binary())] if with_ids else [])], names + ["ids"] * with_ids)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item, longest first, each in the leftmost bin with room.

    Node ``i`` of the tournament tree holds the most free room among the bins below it.
    """
    size = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[item]), 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack_documents(docs: DataFrame, length: int = LENGTH, end_id: int = 0, group_pieces: int = GROUP_PIECES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): a row for each piece.

    A null or empty text is one piece that holds the end id. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Other columns are ignored. ``with_ids`` adds the ids (uint32, little-endian).
    """
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    # an id stands for a byte at least, so there are at most this many pieces
    groups = max(1, -(-(n + size // length) // group_pieces))
    cut = pieces(docs, length, end_id, id_col, text_col, with_ids).withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "copy"), F.lit(groups)).cast("long")).drop("copy")
    names = [c for c in cut.columns if c != "_group"]
    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit(rows["length"].to_numpy(), length)
        return rows[names].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return cut.groupBy("_group").applyInPandas(pack, f"{kinds}, sequence_id long, offset long")
