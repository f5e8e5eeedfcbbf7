"""MinHash near-duplicates by a multi-index Hamming join.

Each distinct shingle set gets ``CHUNK * m`` MinHash symbols of 16 bits. By pigeonhole, two signatures that
differ in at most ``2 * m - 1`` symbols have a chunk with at most one different symbol; enumerating the
place of that error (a key for each chunk and left-out symbol) finds every such pair. ``m`` is the least number
of chunks for which a pair at the similarity threshold exceeds that distance with probability ``MISS`` at most.

No group is expanded into all of its pairs. First each member of a bucket is compared with the bucket's
leader; linked sets form components; then only pairs of different components inside a bucket are
compared. Groups of hot buckets are compared block by block in tasks that hold the full sets, and only links
leave them; a component that a link joins is not compared again. Pairs of two documents of a group's largest
component are never formed. Links are confirmed on full sets of shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import among, materialize, partitions
from .components import connected_components

CHUNK, MISS = 4, 1e-6
#: Buckets of more members are hot. Hot buckets that share members form one group, dealt into blocks of ``BLOCK`` documents;
#: a task compares two blocks.
HOT, BLOCK = 64, 400


def chunks(percent: int) -> int:
    q = 1 - percent / 100
    for m in range(4, 64):
        k = CHUNK * m
        if sum(math.comb(k, d) * q**d * (1 - q) ** (k - d) for d in range(2 * m, k + 1)) <= MISS:
            return m
    raise ValueError(f"no signature length for {percent} percent")


def block_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (52 bits) of each text, and their offsets."""
    low = vec.LOWER[buf]
    starts, ends, first = vec.words(low, offs, vec.NON_SPACE)
    windows, begin = vec.window_hashes(vec.span_hashes(low, starts, ends), first, k)
    return vec.distinct_per_text(windows, begin)


def minhashes(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """``n`` symbols of 16 bits for each text with a set; other rows are zeros."""
    out = np.zeros((len(first) - 1, n), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        rng = np.random.default_rng(77)
        factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for j, f in enumerate(factors):
            least = np.minimum.reduceat(hashes * f, first[full])
            out[full, j] = (vec.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) of (doc_id, text) rows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, offs in vec.text_blocks(batch.column("text")):
                hashes, first = block_sets(buf, offs, k)
                symbols = minhashes(hashes, first, CHUNK * m)
                raw = hashes.tobytes()
                sizes = np.diff(first)
                digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                signs = [symbols[i].tobytes() if s else None for i, s in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n_shingles long, set_hash binary, signature binary")


def index_keys(classes: DataFrame, m: int) -> DataFrame:
    """(key, slot, rep): a key for each chunk and left-out symbol of a signature."""
    id_type = classes.schema["rep"].dataType.simpleString()
    n = CHUNK * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, n).astype(np.uint64)
            keys = np.empty(symbols.shape, np.uint64)
            for slot in range(n):
                chunk = slot - slot % CHUNK
                packed = np.full(len(symbols), slot, np.uint64)
                for j in range(chunk, chunk + CHUNK):
                    if j != slot:
                        packed = (packed << np.uint64(16)) | symbols[:, j]
                keys[:, slot] = vec.mix(packed)
            reps = batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), reps], ["key", "slot", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, f"key long, slot int, rep {id_type}")


def _close(edges: DataFrame, classes: DataFrame, m: int) -> DataFrame:
    """Edges (a, b) whose signatures differ in fewer than ``2 * m`` symbols."""
    sign = classes.select("rep", "signature")
    both = edges.join(sign.select(F.col("rep").alias("a"), F.col("signature").alias("x")), "a").join(sign.select(F.col("rep").alias("b"), F.col("signature").alias("y")), "b")
    n = CHUNK * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, n) for c in ("x", "y"))
            near = pa.array((x != y).sum(1) < 2 * m)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in "ab"))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles): 48 bits of each distinct shingle hash, sorted, six bytes each."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, offs in vec.text_blocks(batch.column("text")):
                hashes, first = block_sets(buf, offs, k)
                raw = np.ascontiguousarray((hashes >> np.uint64(4)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                packed = [raw[6 * a : 6 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(packed, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, f"id {id_type}, shingles binary")


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def confirm(edges: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) whose full sets have ``100 * intersection >= percent * union``."""
    edges = materialize(edges, "pairs")
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets(among(docs, ids, "doc_id"), k), "sets")
    both = edges.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = _unpack(x.as_py()), _unpack(y.as_py())
                joined = np.sort(np.concatenate((p, q)))
                common = int((joined[1:] == joined[:-1]).sum())
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in "ab"))


def _apart(members: DataFrame, m: int) -> DataFrame:
    """Pairs of members of a small bucket, of different components, with close signatures; each pair comes from its first shared key alone.

    members: (key, slot, rep, component, signature), at most ``HOT`` rows of each key.
    """
    n = CHUNK * m
    id_type = members.schema["rep"].dataType.simpleString()

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        symbols = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, n)
        rep, component, slot = rows["rep"].to_numpy(), pd.factorize(rows["component"])[0], int(rows["slot"].iloc[0])
        same = symbols[:, None, :] == symbols[None, :, :]
        i, j = np.nonzero(np.triu(component[:, None] != component[None, :]) & (n - same.sum(2) < 2 * m))
        eq = same[i, j].reshape(-1, m, CHUNK)
        chunk = (eq.sum(2) >= CHUNK - 1).argmax(1)
        at = np.arange(len(i))
        first = chunk * CHUNK + np.where(eq[at, chunk].all(1), 0, eq[at, chunk].argmin(1)) if len(i) else at
        return pd.DataFrame({"a": rep[i[first == slot]], "b": rep[j[first == slot]]})

    return members.select("key", "slot", "rep", "component", "signature").groupBy("key").applyInPandas(pairs, f"a {id_type}, b {id_type}")


def _hot_links(hot: DataFrame, m: int, percent: int) -> DataFrame:
    """Links between members of hot groups that are of different components.

    hot: (group, rep, component, signature, shingles). The members of a group's largest component and the others are dealt into
    blocks of their own; a task has a block of the others and any second block.
    """
    n = CHUNK * m
    id_type = hot.schema["rep"].dataType.simpleString()
    sizes = hot.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("group").agg(F.max_by("component", "n").alias("largest"), F.max("n").alias("n_large"), (F.sum("n") - F.max("n")).alias("n_other")).filter("n_other > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    spot = F.xxhash64("rep")
    dealt = hot.join(groups, "group").withColumns({"other": F.col("component") != F.col("largest"), "large_blocks": blocks("n_large"), "other_blocks": blocks("n_other")})
    dealt = dealt.withColumn("own", F.when(F.col("other"), F.col("large_blocks") + F.pmod(spot, "other_blocks")).otherwise(F.pmod(spot, "large_blocks")).cast("int"))
    mates = F.when(F.col("other"), F.sequence(F.lit(0), F.col("large_blocks") + F.col("other_blocks") - 1)).otherwise(F.sequence(F.col("large_blocks"), F.col("large_blocks") + F.col("other_blocks") - 1))
    dealt = dealt.withColumn("mate", F.explode(mates)).withColumns({"low": F.least("own", "mate"), "high": F.greatest("own", "mate")})

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        symbols = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, n)
        rep, component, own = rows["rep"].to_numpy(), pd.factorize(rows["component"])[0], rows["own"].to_numpy()
        sets = [_unpack(x) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        within = bool((rows["low"] == rows["high"]).iloc[0])
        out: list[tuple] = []
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
            near = ((symbols[rest] != symbols[i]).sum(1) < 2 * m) & (100 * low >= percent * high)
            if not within:
                near &= own[rest] != own[i]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if component[i] != component[j]:
                    both = np.sort(np.concatenate((sets[i], sets[j])))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        out.append((rep[i], rep[j]))
                        component[component == component[j]] = component[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": rep.dtype, "b": rep.dtype})

    # dealt out by pair of blocks: what the join left is dealt by group, and a grouping by more keys would keep that
    dealt = dealt.select("group", "rep", "component", "signature", "shingles", "own", "low", "high").repartition(partitions(hot.sparkSession), "group", "low", "high")
    return dealt.groupBy("group", "low", "high").applyInPandas(links, f"a {id_type}, b {id_type}")


def group_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each input row.

    Documents with fewer than ``k`` words have their whole sequence as one shingle; null, empty and wordless texts have no
    set and are linked with nothing. Equal sets are one class, so copies are never paired. Rows that share an id are
    one node; rows of a null id are never smallest. An empty table gives an empty result; other columns are ignored.
    """
    m = chunks(percent)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(narrow, k, m), "signed")
    classes = materialize(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature"), F.count(F.lit(1)).alias("n")), "classes")

    keys = index_keys(classes, m)
    # buckets of one chunk order their members alike, those of another chunk in another way: a large group gets a leader from each chunk
    order = F.xxhash64("rep", F.floor(F.col("slot") / CHUNK))
    buckets = keys.groupBy("key").agg(F.min_by("rep", order).alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(keys.join(buckets, "key"), "members")
    led = members.filter("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    tried = materialize(_close(led, classes, m), "tried")
    linked = materialize(confirm(tried, narrow, k, percent), "linked")
    first = materialize(connected_components(linked), "components")

    named = first.select(F.col("node").alias("rep"), "component")
    sign = classes.select("rep", "signature")
    labelled = members.filter(f"size between 3 and {HOT}").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    left = labelled.join(open_keys, "key", "left_semi").join(sign, "rep")
    apart = _apart(left, m).distinct().join(tried, ["a", "b"], "left_anti")

    hot = members.filter(f"size > {HOT}").select("leader", "rep").distinct()
    groups = connected_components(hot.filter("leader <> rep").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    groups = materialize(groups.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(sign, "rep"), "hot")
    sets = _sets(among(narrow, groups.select(F.col("rep").alias("id")).distinct(), "doc_id"), k).dropDuplicates(["id"])
    across = _hot_links(groups.join(sets, F.col("rep") == F.col("id")), m, percent)

    more = confirm(apart, narrow, k, percent).unionByName(across)
    label = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    bridges = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    stars = first.filter("node > component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    final = connected_components(stars.union(bridges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))

    # classes of one member need no lookup, so only copies and linked sets take part in these joins
    reps = classes.filter("n > 1").select("set_hash", "rep")
    out = signed.select("doc_id", "n_shingles", "set_hash").join(reps, "set_hash", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a smaller id, with all columns whatever their names.

    Texts without words and rows of a null id stay; rows that share an id stay or go together; an empty table stays empty.
    """
    dropped = materialize(group_documents(docs, k, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("id")).distinct(), "dropped")
    return among(docs, dropped, id_col, "left_anti")
