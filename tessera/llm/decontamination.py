"""Benchmark decontamination with an FM-index for each training shard.

A shard is one block of whole texts. Words of the benchmark get ids; runs of at least a window of such
words are the only places where a window can occur, so the index is built over these runs (with separators).
Windows are searched backwards, occurrences located, and the covered words merged into removal spans. No
shuffle: a benchmark larger than ``BLOCK_BYTES`` is dealt into blocks, each searched in a job of its own whose hits,
by text, go to the shared folder and are merged at the end; driver and tasks hold the windows of one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import masked, shared_path, unmasked
from .fm_index import FMIndex

WINDOW = 10
#: Most bytes of benchmark text that one pass searches for (and that the driver and a task hold at once).
BLOCK_BYTES = 4 << 20
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_SCHEMA = "_found struct<n_words: long, spans: array<struct<begin: long, end: long>>, items: array<string>>"


def _lower_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = vec.LOWER[buf]
    starts, ends, first = vec.words(low, offs, vec.ALNUM)
    return starts, ends, first, vec.span_hashes(low, starts, ends)


class Windows:
    """The windows of one block of benchmark items, as ids of their words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        ids, texts = zip(*items, strict=True) if items else ((), ())
        hashes, counts = [np.zeros(0, np.uint64)], []
        for _, _, buf, offs in vec.text_blocks(pa.array(texts, pa.string())):
            *_, first, h = _lower_words(buf, offs)
            hashes.append(h)
            counts.extend(np.diff(first))
        all_words = np.concatenate(hashes)
        counts = np.array(counts, np.int64)
        self.vocabulary, word_ids = np.unique(all_words, return_inverse=True)
        n_windows = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(counts)), n_windows)
        begin = np.cumsum(counts) - counts
        at = np.repeat(begin - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
        size = np.minimum(counts, window)[owner]
        table = np.zeros((len(at), window), np.int64)
        for j in range(window):
            has = size > j  # right-aligned
            table[has, window - 1 - j] = word_ids[at[has] + size[has] - 1 - j] + 2
        rows = np.column_stack((size, table))
        unique, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.sizes, self.patterns = unique[:, 0], unique[:, 1:]
        order = np.argsort(which.ravel(), kind="stable")
        self.owners = owner[order]
        self.owner_first = np.searchsorted(which.ravel()[order], np.arange(len(unique) + 1))
        self.item_ids = list(ids)
        self.least = int(self.sizes.min()) if len(unique) else 0
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids from 2 on; 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 2
        return out

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence in a shard, whose texts begin at words ``first``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.sizes) or not len(hashes):
            return none
        ids = self.word_ids(hashes)
        known = ids > 0
        breaks = np.zeros(len(ids) + 1, bool)
        breaks[first] = True
        start = known & (breaks[:-1] | ~np.concatenate(([False], known[:-1])))
        end = known & (breaks[1:] | ~np.concatenate((known[1:], [False])))
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return none
        lengths = ends - starts
        # run 1 separator run 1 separator ... 0
        place = np.cumsum(lengths + 1) - lengths - 1
        inner = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        text = np.ones(int((lengths + 1).sum()) + 1, np.int64)
        text[np.repeat(place - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = ids[inner]
        text[-1] = 0
        index = FMIndex(text, len(self.vocabulary) + 2)
        low, high = index.search(self.patterns, self.sizes)
        n = np.maximum(high - low, 0)
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window = np.repeat(np.arange(len(n)), n)
        at = index.locate(rows)
        run = np.searchsorted(place, at, "right") - 1
        return starts[run] + at - place[run], window

    def mark(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(n_words, spans, items) of each text."""
        found: list[tuple] = [(int(n), [], []) for n in np.diff(first)]
        at, window = self.occurrences(hashes, first)
        if not len(at):
            return found
        text = np.searchsorted(first, at, "right") - 1
        order = np.argsort(text, kind="stable")
        hit_texts, begins = np.unique(text[order], return_index=True)
        for t, mine in zip(hit_texts.tolist(), np.split(order, begins[1:]), strict=True):
            change = np.zeros(int(first[t + 1] - first[t]) + 1, np.int64)
            np.add.at(change, at[mine] - first[t], 1)
            np.add.at(change, at[mine] - first[t] + self.sizes[window[mine]], -1)
            hit = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
            edges = np.flatnonzero(hit[1:] != hit[:-1])
            named = {self.item_ids[o] for w in np.unique(window[mine]) for o in self.owners[self.owner_first[w] : self.owner_first[w + 1]]}
            found[t] = (found[t][0], [{"begin": int(b), "end": int(e)} for b, e in zip(edges[::2], edges[1::2], strict=True)], sorted(named))
        return found


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``_found``: number of words, merged spans of hit words, ids of the items found (as strings).

    Null and empty texts have no words. Items without words, or with a null id, never match. A repeated item counts once.
    """
    usable = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("item_id").isNotNull())
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    kept = [c for c in docs.columns if keep_text or c != text_col]
    if n_blocks == 1:
        return _one_pass(docs, _windows(usable, window), text_col, kept)
    spark = docs.sparkSession
    items, hits = shared_path(spark, "benchmark"), shared_path(spark, "hits")
    usable.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))).write.partitionBy("_block").parquet(items)
    texts = docs.select(F.col(text_col).alias("_text"))
    for b in range(n_blocks):
        found = _one_pass(texts, _windows(spark.read.parquet(items).filter(F.col("_block") == b), window), "_text", ["_text"])
        found.filter(F.size("_found.spans") > 0).select(F.md5(F.col("_text").cast("binary")).alias("_key"), "_found.spans", "_found.items").dropDuplicates(["_key"]).write.parquet(f"{hits}/{b}")
    each = spark.read.parquet(*(f"{hits}/{b}" for b in range(n_blocks))).groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = each.select("_key", _merged("spans").alias("_spans"), F.col("items").alias("_items"))
    counted = _one_pass(docs.withColumn("_key", F.md5(F.col(text_col).cast("binary"))), Windows([], window), text_col, [*kept, "_key"])
    both = counted.join(merged, "_key", "left")
    none = F.col("_found")
    return both.select(*kept, F.struct(none["n_words"].alias("n_words"), F.coalesce("_spans", none["spans"]).alias("spans"), F.coalesce("_items", none["items"]).alias("items")).alias("_found"))


def _windows(items: DataFrame, window: int) -> Windows:
    """The windows of a block: about ``BLOCK_BYTES`` of text, as ids are hashed into blocks."""
    return Windows(sorted((r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()), window)


def _merged(spans: str) -> Column:
    """Spans of words joined where they overlap or touch, in order."""
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, s: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["begin"].alias("begin"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["begin"]), longer(done, s)).otherwise(F.concat(done, F.array(s))))


def _one_pass(docs: DataFrame, windows: Windows, text_col: str, kept: list[str]) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), _SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, offs in vec.text_blocks(batch.column(text_col)):
                part = batch.slice(begin, end - begin)
                *_, first, hashes = _lower_words(buf, offs)
                found = pa.array([dict(zip(("n_words", "spans", "items"), r, strict=True)) for r in windows.mark(hashes, first)], _FOUND)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], [*kept, "_found"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans), a row for each input row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_benchmark(narrow, benchmark, window, keep_text=False)
    f = F.col("_found")
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(f["items"]), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), f["spans"].alias("spans"))


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut out of the text (each from its first word to its last) and n_chars, if there, counted anew.

    All rows and columns stay, whatever their names. Null texts stay null, and texts without hits stay as they are; repeated rows
    are cut alike; an empty table stays empty.
    """
    df, name = masked(docs)
    text = name[text_col]
    found = find_benchmark(df, benchmark, window, text)
    at = found.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, f in enumerate(batch.column("_found").to_pylist()):
                if not f["spans"]:
                    continue
                raw = texts[i].encode()
                starts, ends, _ = vec.words(vec.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), vec.ALNUM)
                kept, last = [], 0
                for s in f["spans"]:
                    kept.append(raw[last : starts[s["begin"]]])
                    last = int(ends[s["end"] - 1])
                texts[i] = b"".join([*kept, raw[last:]]).decode()
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = unmasked(found.mapInArrow(run, df.schema), docs)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def oracle(window: int = WINDOW) -> str:
    """The same report by joining 10-word windows; items of fewer words are matched by their own length."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with items as (select item_id, {words} as ws from benchmark),
win as (select distinct item_id, len(w) as k, array_to_string(w, ' ') as w from (
  select item_id, ws[i : i + least(len(ws), {window}) - 1] as w
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) as i from items where len(ws) > 0))),
d as (select doc_id, {words} as ws from documents),
dw as (select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') as w
       from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, (select distinct k from win))),
hit as (select doc_id, item_id, i, k from dw join win using (k, w)),
pos as (select distinct doc_id, unnest(range(i, i + k)) as p from hit),
n as (select doc_id, count(*) as n_hit from pos group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item_id::VARCHAR, ',' order by item_id::VARCHAR) as ids
       from (select distinct doc_id, item_id from hit) group by 1)
select doc_id, len(ws)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)
"""
