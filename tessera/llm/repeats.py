"""Removal of 50-byte repeats across documents by suffix sorting.

1. Equal texts: the smallest id stands for all; the others are removed whole (from 50 bytes on).
2. Every 50-byte window has an anchor, its 20-byte string of least hash, so equal windows have equal anchors.
   Anchor hashes are dealt into buckets; those that only one document has are dropped.
3. Documents with other anchors send the context of each (the bytes of all windows that it anchors) to the
   anchor's bucket, each distinct context of a task once.
4. A bucket joins its distinct contexts into texts and sorts their suffixes by grouping
   (``lyndon_sort``). Neighbours in suffix order that share 50 bytes are one string; its smallest document
   id goes to every place where it occurs.
5. Places whose string has a smaller document go back to their documents and are merged into spans.

Rows between the steps hold packed arrays, and buckets and parts grow in number with the input
(``BUCKET_BYTES`` of text each), so a task holds a bounded share. A passage that many documents hold is one
context with a smallest id, however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import among
from .lyndon_sort import suffix_array

LENGTH, GRAM = 50, 20
#: How far contexts agree beyond their anchor is found in steps of so many bytes.
STEP = 3
BUCKET_BYTES = 8 << 20
FLUSH_ANCHORS = 600_000
#: Bytes of text whose anchors are found at once; the arrays for that take about 100 times as much.
ANCHOR_BYTES = 1 << 20
#: Bytes of contexts that are suffix-sorted as one text.
SORT_BYTES = 16_384
#: Longer blocks (one long text) are gone through in overlapping parts: a place takes the 28 low bits of a hash.
PART_BYTES = 1 << 27
_LOW = np.uint64(28)


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, text, first window, last window, place) of each run of windows with one anchor."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    n = len(buf)
    if n < length:
        return none
    if n > PART_BYTES:
        parts = []
        for at in range(0, n - length + 1, PART_BYTES - length + 1):
            h, text, start, last, place = anchors(buf[at : at + PART_BYTES], np.clip(offs - at, 0, min(PART_BYTES, n - at)), length, gram)
            parts.append((h, text, start + at, last + at, place + at))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.arange(n - gram + 1)
    hashes = vec.span_hashes(buf, at, at + gram)
    # least hash and then leftmost: the place goes into the low bits
    least = (hashes >> _LOW << _LOW) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & ((np.uint64(1) << _LOW) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(place)]
    starts = np.flatnonzero(np.arange(len(place)) + length <= offs[text + 1])
    if not len(starts):
        return none
    place = place[starts]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return hashes[place[first]], text[starts[first]], starts[first], starts[last], place[first]


class Pack:
    """Named arrays in one binary value."""

    @staticmethod
    def dump(*arrays: np.ndarray) -> bytes:
        return b"".join([np.array([len(a) * a.itemsize for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])

    @staticmethod
    def load(raw: bytes, *types: str) -> list[np.ndarray]:
        sizes, at, out = np.frombuffer(raw, "<i8", len(types)), 8 * len(types), []
        for size, t in zip(sizes.tolist(), types, strict=True):
            out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
            at += size
        return out


def _split(key: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows by key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [a[order] for a in arrays]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    for a, b in zip(first, [*first[1:], len(key)], strict=True):
        yield int(key[a]), [x[a:b] for x in arrays]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFF)) % np.uint64(n)).astype(np.int64)


def _batch(rows: list[tuple[int, bytes]], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], [key, "pack"])


_ANCHORS = ("<u4", "u1", "<u4", "<i8", "<u4", "<u4")


def send_anchors(texts: DataFrame, n: int) -> DataFrame:
    """(bucket, pack): hash bits, first windows, and run-length coded ids and parts of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes, starts, ids, parts = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = []
            for b, (h, s, i, p) in _split(_bucket(hashes, n), [hashes, starts, ids, parts]):
                first, count = _runs(i)
                rows.append((b, Pack.dump((h >> np.uint64(32)).astype("<u4"), (h >> np.uint64(24)).astype("u1"), s.astype("<u4"), i[first].astype("<i8"), count.astype("<u4"), p[first].astype("<u4"))))
            return _batch(rows, "bucket")

        for batch in batches:
            ids, parts = batch.column("doc_id").to_numpy(), batch.column("part").to_numpy()
            for begin, _, buf, offs in vec.text_blocks(batch.column("text"), ANCHOR_BYTES):
                hashes, text, start, _, _ = anchors(buf, offs)
                if len(hashes):
                    held.append([hashes, start - offs[text], ids[begin + text], parts[begin + text]])
                    size += len(hashes)
                if size > FLUSH_ANCHORS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "bucket int, pack binary")


def shared_anchors(sent: DataFrame) -> DataFrame:
    """(part, pack): (document, first window) of the anchors that two documents or more have."""

    def run(table: pa.Table) -> pa.Table:
        loaded = [Pack.load(x.as_py(), *_ANCHORS) for x in table.column("pack")]
        key = np.concatenate([(a.astype(np.uint64) << np.uint64(8)) | b for a, b, *_ in loaded])
        start = np.concatenate([x[2] for x in loaded])
        ids = np.concatenate([np.repeat(x[3], x[4]) for x in loaded])
        parts = np.concatenate([np.repeat(x[5], x[4]) for x in loaded])
        order = np.argsort(key, kind="stable")
        first, count = _runs(key[order])
        mine = ids[order]
        several = np.minimum.reduceat(mine, first) != np.maximum.reduceat(mine, first)
        found = np.sort(order[np.repeat(several, count)])
        rows = [(p, Pack.dump(i, s)) for p, (i, s) in _split(parts[found], [ids[found], start[found]])]
        return pa.Table.from_batches([_batch(rows, "part")])

    return sent.groupBy("bucket").applyInArrow(run, "part int, pack binary")


_CONTEXTS = ("u1", "u1", "u1", "<u4", "<i8", "<u4", "<u4")


def send_contexts(texts: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(bucket, pack): distinct contexts (bytes, length, place of the anchor), and the (context, document, first window, part) of each occurrence."""

    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        held: list[list[np.ndarray]] = []
        if len(packs) and len(docs):
            part = docs.column("part")[0].as_py()
            loaded = [Pack.load(x.as_py(), "<i8", "<u4") for x in packs.column("pack")]
            want_id, want_start = (np.concatenate(x) for x in zip(*loaded, strict=True))
            known = np.unique(want_id)
            want = np.sort((np.searchsorted(known, want_id) << 32) | want_start)
            ids = docs.column("doc_id").to_numpy()
            has = np.flatnonzero(np.isin(ids, known))
            docs, ids = docs.take(pa.array(has)), ids[has]
            for begin, _, buf, offs in vec.text_blocks(docs.column("text"), ANCHOR_BYTES):
                hashes, text, start, last, place = anchors(buf, offs)
                if not len(hashes):
                    continue
                own, local = ids[begin + text], start - offs[text]
                key = (np.searchsorted(known, own) << 32) | local
                c = np.flatnonzero(want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key)
                if len(c):
                    size = last[c] - start[c] + LENGTH
                    held.append([hashes[c], own[c], local[c], place[c] - start[c], size, buf[np.repeat(start[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())]])
        rows: list[tuple[int, bytes]] = []
        if held:
            hashes, own, local, place, size, blob = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.cumsum(size)
            text_hash = vec.span_hashes(blob, ends - size, ends)
            unique, index, which = np.unique(text_hash, return_index=True, return_inverse=True)
            bucket = _bucket(hashes, n)
            for b, (rows_of,) in _split(bucket, [np.arange(len(bucket))]):
                contexts, number = np.unique(which[rows_of], return_inverse=True)
                at = index[contexts]
                lengths = size[at]
                text = blob[np.repeat(ends[at] - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
                rows.append((b, Pack.dump(text, lengths.astype("u1"), place[at].astype("u1"), number.astype("<u4"), own[rows_of].astype("<i8"), local[rows_of].astype("<u4"), np.full(len(rows_of), part, "<u4"))))
        return pa.Table.from_batches([_batch(rows, "bucket")])

    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, "bucket int, pack binary")


def smallest_documents(text: np.ndarray, lengths: np.ndarray, place: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest document of each window of each context, first window of each context and the end).

    text holds distinct contexts one after the other; ``least`` has the smallest document of each context.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n_windows = lengths - LENGTH + 1
    window = np.concatenate(([0], np.cumsum(n_windows)))
    out = np.repeat(least, n_windows)
    hashes = vec.SpanHasher(text)
    at = starts + place
    anchor = hashes(at, at + GRAM)

    def agrees(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether another context of the same anchor has the same bytes from begin to end (none where they leave the context)."""
        inside = (begin >= starts) & (end <= ends)
        h = np.where(inside, hashes(np.maximum(begin, starts), np.minimum(end, ends)) ^ anchor, np.uint64(0))
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        return inside & (count[which.ravel()] > 1)

    # a shared window reaches from the anchor to the left and to the right by 30 bytes together, and no further than the
    # contexts agree with another one on each side; what lies beyond that has nothing to be compared with
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(STEP, LENGTH - GRAM + 1, STEP):
        left[agrees(at - k, at + GRAM)] = k
        right[agrees(at, at + GRAM + k)] = k
    low, high = np.maximum(starts, at - left - STEP + 1), np.minimum(ends, at + GRAM + right + STEP - 1)
    several = np.unique(anchor, return_inverse=True, return_counts=True)
    sorted_ones = np.flatnonzero((high - low >= LENGTH) & (several[2][several[1].ravel()] > 1))
    order = sorted_ones[np.argsort(anchor[sorted_ones], kind="stable")]
    first, _ = _runs(anchor[order])
    group_ends = np.append(first[1:], len(order))
    raw = text.tobytes()
    begin = 0
    for k, end in enumerate(group_ends.tolist()):
        total = int((high - low)[order[begin:end]].sum())
        if total >= SORT_BYTES or k == len(group_ends) - 1:
            _merge(raw, low, high, window + np.append(low - starts, 0), order[begin:end], out)
            begin = end
    return out, window


def _merge(raw: bytes, low: np.ndarray, high: np.ndarray, window: np.ndarray, contexts: np.ndarray, out: np.ndarray) -> None:
    """Give each string of ``LENGTH`` bytes in the contexts, from low to high, the smallest document of all its windows; window: number of the first."""
    parts, slots = [], []
    for c in contexts.tolist():
        a, n = int(low[c]), int(high[c] - low[c])
        parts.append(raw[a : a + n])
        slots.extend(range(int(window[c]), int(window[c]) + n - LENGTH + 1))
        slots.extend([-1] * LENGTH)
    slots.append(-1)
    joined = b"\0".join(parts)
    # symbols: 0 ends the text, 1 parts contexts, bytes follow
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    cuts = np.cumsum([len(p) + 1 for p in parts])[:-1] - 1
    symbols[cuts] = 1
    order = suffix_array([*symbols.tolist(), 0])
    before, same = b"", []

    def close() -> None:
        if len(same) > 1:
            out[same] = out[same].min()

    for i in order:
        slot = slots[i]
        if slot < 0:
            continue
        now = joined[i : i + LENGTH]
        if now == before:
            same.append(slot)
        else:
            close()
            before, same = now, [slot]
    close()


def repeated_places(sent: DataFrame) -> DataFrame:
    """(part, pack): (document, begin, end) of bytes covered by strings that a smaller document has."""

    def run(table: pa.Table) -> pa.Table:
        loaded = [Pack.load(x.as_py(), *_CONTEXTS) for x in table.column("pack")]
        text, lengths, place = (np.concatenate([x[j] for x in loaded]) for j in range(3))
        lengths, place = lengths.astype(np.int64), place.astype(np.int64)
        shift = np.cumsum([0] + [len(x[1]) for x in loaded])
        number = np.concatenate([x[3].astype(np.int64) + s for x, s in zip(loaded, shift, strict=False)])
        own, local, parts = (np.concatenate([x[j] for x in loaded]) for j in (4, 5, 6))
        ends = np.cumsum(lengths)
        _, index, which = np.unique(vec.span_hashes(text, ends - lengths, ends), return_index=True, return_inverse=True)
        number = which.ravel()[number]
        size = lengths[index]
        text = text[np.repeat(ends[index] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, number, own)
        smallest, window = smallest_documents(text, size, place[index], least)
        rows: dict[int, list[list[np.ndarray]]] = {}
        for a in range(0, len(number), 200_000):
            num, mine, start, part = (x[a : a + 200_000] for x in (number, own, local, parts))
            count = np.diff(window)[num]
            flat = np.repeat(window[num] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            occurrence = np.repeat(np.arange(len(num)), count)
            hit = smallest[flat] < mine[occurrence]
            o, offset = occurrence[hit], (flat - window[num][occurrence])[hit]
            new = np.concatenate(([True], (o[1:] != o[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(o) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(o))[: len(first)] - 1
            begin, end = start[o[first]].astype(np.int64) + offset[first], start[o[first]].astype(np.int64) + offset[last] + LENGTH
            for p, arrays in _split(part[o[first]].astype(np.int64), [mine[o[first]], begin.astype("<u4"), end.astype("<u4")]):
                rows.setdefault(p, []).append(arrays)
        return pa.Table.from_batches([_batch([(p, Pack.dump(*(np.concatenate(x) for x in zip(*v, strict=True)))) for p, v in rows.items()], "part")])

    return sent.groupBy("bucket").applyInArrow(run, "part int, pack binary")


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes covered by the ranges."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


_SPANS = "array<struct<begin: long, end: long>>"


def _document_spans(texts: DataFrame, places: DataFrame) -> DataFrame:
    """texts with ``spans`` and ``kept_sha256``."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").to_numpy()
        loaded = [Pack.load(x.as_py(), "<i8", "<u4", "<u4") for x in packs.column("pack")]
        own, begin, end = (np.concatenate(x) for x in zip(*loaded, strict=True)) if loaded else (np.zeros(0, np.int64),) * 3
        order = np.argsort(own, kind="stable")
        own, begin, end = own[order], begin[order].astype(np.int64), end[order].astype(np.int64)
        spans, digests, sizes = [], [], []
        for i, text in zip(ids, docs.column("text"), strict=True):
            raw = (text.as_py() or "").encode()
            a, b = np.searchsorted(own, i, "left"), np.searchsorted(own, i, "right")
            mine: list[tuple[int, int]] = []
            if b > a:
                mine = list(zip(*(x.tolist() for x in merge_spans(begin[a:b], end[a:b])), strict=True))
            kept, at = hashlib.sha256(), 0
            for x, y in mine:
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            digests.append(kept.hexdigest())
            sizes.append(len(raw))
            spans.append([{"begin": x, "end": y} for x, y in mine])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, span), "kept_sha256": pa.array(digests, pa.string())})

    return texts.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(run, f"doc_id long, n_bytes long, spans {_SPANS}, kept_sha256 string")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each input row.

    Null and empty texts have no bytes. Rows that share an id count as one document against all others, and each is cut by what
    smaller ids hold. Rows of a null id are never cut and cut nothing. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    # a row is known by the digest of its text and its id
    keyed = narrow.withColumn("row", F.concat(F.unhex(F.md5(F.col("text").cast("binary"))), F.unhex(F.lpad(F.hex("doc_id"), 16, "0"))))
    named = keyed.filter("doc_id is not null").select("doc_id", "row", F.substring("row", 1, 16).alias("md5"))
    several = named.groupBy("md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = named.join(several, "md5").filter("doc_id > first").select(F.col("row").alias("id")).distinct()
    untouched = keyed.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr(f"cast(array() as {_SPANS})").alias("spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    size = F.octet_length("text").cast("long")
    whole = among(keyed.filter("doc_id is not null"), copies, "row").select(
        "doc_id",
        size.alias("n_bytes"),
        F.expr(f"case when octet_length(text) >= {LENGTH} then array(named_struct('begin', 0L, 'end', cast(octet_length(text) as long))) else cast(array() as {_SPANS}) end").alias("spans"),
        F.when(size >= LENGTH, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
    )
    texts = among(keyed.filter("doc_id is not null"), copies, "row", "left_anti").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("part"))
    found = shared_anchors(send_anchors(texts, n))
    places = repeated_places(send_contexts(texts, found, n))
    out = _document_spans(texts, places).unionByName(whole).unionByName(untouched)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
