"""Periodic runs of words: stretches that repeat a short sequence of words at least four times.

The texts of a block are laid end to end as integers, each word marked by its text and each text between separators of its
own, so nothing matches across texts. A suffix array of this sequence, one of its reverse, their arrays of common prefixes and
range minima answer how far two places agree forwards and backwards. For each period p the places jp and (j + 1)p of the grid are
asked: a run of at least four periods holds such a pair, and the two answers give its whole stretch. Together the grids have
n ln n places. All work is inside a text: nothing is shuffled, and memory follows the block or the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_PERIODS = 6, 4
#: Words of a block; a longer text is a block of its own.
BLOCK_WORDS = 1 << 18
#: Pairs of the grid that are asked at once.
PAIRS = 1 << 20
_STEP = 32


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, rank of each) by prefix doubling; only groups that are still tied are sorted again. The last key occurs once."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    sorted_keys, slots, ahead = keys[order], np.arange(n), 1
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(slots)))
        rank[order[slots]] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order, rank
        at = order[slots]
        pair = rank[at] * n + rank[at + ahead]
        turn = np.argsort(pair, kind="stable")
        order[slots], sorted_keys, ahead = at[turn], pair[turn], 2 * ahead


def common_prefixes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the order.

    Most are short and found a symbol at a time for all together; longer ones go through the places in turn, where a
    common prefix is at most one shorter than that of the place before, so the whole is linear.
    """
    n = len(keys)
    found = np.zeros(n, np.int64)
    left, right, open_ = order[1:], order[:-1], np.arange(n - 1)
    for step in range(_STEP):
        open_ = open_[keys[left[open_] + step] == keys[right[open_] + step]]
        if not len(open_):
            return found
        found[open_ + 1] = step + 1
    open_ = open_[np.argsort(left[open_])]
    symbols, lengths, before, length = keys.tolist(), [], -2, 0
    for i, j in zip(left[open_].tolist(), right[open_].tolist(), strict=True):
        length = max(_STEP, length - 1) if i == before + 1 else _STEP
        while symbols[i + length] == symbols[j + length]:
            length += 1
        lengths.append(length)
        before = i
    found[open_ + 1] = lengths
    return found


class RangeMinimum:
    """Minima of ranges: a sparse table over blocks of ``_STEP`` values, and minima from each block's two ends."""

    def __init__(self, values: np.ndarray):
        rows = -(-len(values) // _STEP)
        self.grid = np.full((rows, _STEP), np.iinfo(np.int64).max)
        self.grid.reshape(-1)[: len(values)] = values
        self.ahead = np.minimum.accumulate(self.grid, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(self.grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [self.grid.min(axis=1)]
        while (1 << len(self.levels)) <= rows:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[: len(last) - half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included."""
        first, last = low // _STEP, high // _STEP
        found = np.minimum(self.behind[low], self.ahead[high])
        one = np.flatnonzero(first == last)
        if len(one):
            columns = np.arange(_STEP)
            inside = (columns >= (low[one] % _STEP)[:, None]) & (columns <= (high[one] % _STEP)[:, None])
            found[one] = np.where(inside, self.grid[first[one]], np.iinfo(np.int64).max).min(axis=1)
        between = last - first - 1
        for k, level in enumerate(self.levels):
            at = np.flatnonzero((between >> k) == 1) if k else np.flatnonzero(between == 1)
            if len(at):
                found[at] = np.minimum(found[at], np.minimum(level[first[at] + 1], level[last[at] - (1 << k)]))
        return found


class Extension:
    """How many symbols are equal from two places on (longest common extension). Every symbol that ends a text occurs once."""

    def __init__(self, keys: np.ndarray):
        order, self.rank = suffix_array(keys)
        self.minimum = RangeMinimum(common_prefixes(keys, order))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minimum(np.minimum(a, b) + 1, np.maximum(a, b))


def find_runs(texts: list[list[int]], least: int = MIN_LENGTH, periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.concatenate(([1], sizes[:-1] + 1))) if len(sizes) else np.zeros(0, np.int64)
    n = int(sizes.sum()) + len(texts) + 1
    symbols = np.concatenate([np.asarray(t, np.int64) for t in texts] or [np.zeros(0, np.int64)])
    width = int(symbols.max(initial=-1)) + 2
    text = np.repeat(np.arange(len(texts)), sizes)
    keys = np.zeros(n, np.int64)
    keys[np.concatenate((starts - 1, [n - 1])).astype(np.int64)] = np.arange(len(texts) + 1) * width
    keys[np.arange(len(symbols)) + text + 1] = text * width + symbols + 1
    ahead, back = Extension(keys), Extension(keys[::-1].copy())

    found = []

    def ask(pairs: list[tuple[int, np.ndarray]]) -> None:
        i = np.concatenate([at for _, at in pairs])
        p = np.repeat([q for q, _ in pairs], [len(at) for _, at in pairs])
        end = i + p + ahead(i, i + p)
        start = i + 1 - back(n - 1 - i, n - 1 - i - p)
        good = end - start >= np.maximum(least, periods * p)
        stretch, once = np.unique(start[good] * (n + 1) + end[good], return_index=True)
        found.append(np.stack((stretch // (n + 1), stretch % (n + 1), p[good][once])))

    pairs, held = [], 0
    for p in range(1, int(sizes.max(initial=0)) // periods + 1):
        grid = keys[::p]
        same = np.flatnonzero(grid[1:] == grid[:-1]) * p
        if len(same):
            pairs.append((p, same))
            held += len(same)
        if held >= PAIRS:
            ask(pairs)
            pairs, held = [], 0
    if pairs:
        ask(pairs)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        start, end, p = np.concatenate(found, axis=1)
        # periods were asked in ascending order: the first of a stretch is its smallest
        _, once = np.unique(start * (n + 1) + end, return_index=True)
        start, end, p = start[once], end[once], p[once]
        of = np.searchsorted(starts, start, "right") - 1
        turn = np.lexsort((p, start))
        for d, s, e, q in zip(of[turn].tolist(), start[turn].tolist(), end[turn].tolist(), p[turn].tolist(), strict=True):
            runs[d].append((s - int(starts[d]), e - s, q))
    return runs


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, their tail made periodic in a tenth of the documents: a stated function of the id (a null id changes nothing)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without what any run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    if not runs:
        return b" ".join(words)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist())


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _blocks(batches: Iterator[pa.RecordBatch], damage: bool) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()
            ids.append(doc_id.as_py())
            texts.append(repeat_tail(words, ids[-1]) if damage else words)
            held += len(words)
            if held >= BLOCK_WORDS or len(ids) >= 10_000:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def report_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): a row for each input row.

    Words are split at ASCII white space. start, length, period and exponent_milli are those of the longest run, then of the smallest
    start and period; null without a run. A null or blank text has no words (digests of the empty string); a null id stays
    null; repeated rows are reported each; an empty table gives an empty result; other columns are ignored. damage: apply
    ``repeat_tail`` first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, damage):
            number: dict[bytes, int] = {}
            found = find_runs([[number.setdefault(w, len(number)) for w in words] for words in texts])
            rows = []
            for doc_id, words, runs in zip(ids, texts, found, strict=True):
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rows.append((doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest()))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def collapse_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the words of ``text_col`` joined by one space and each run cut to its first period; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t.as_py() for t in batch.column(at)]
            out = []
            for begin in range(0, len(texts), 200):
                words = [(t or "").encode().split() for t in texts[begin : begin + 200]]
                number: dict[bytes, int] = {}
                runs = find_runs([[number.setdefault(w, len(number)) for w in ws] for ws in words])
                out += [collapse(ws, rs).decode() for ws, rs in zip(words, runs, strict=True)]
            column = pa.array([None if t is None else o for t, o in zip(texts, out, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
