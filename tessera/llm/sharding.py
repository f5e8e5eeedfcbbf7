"""Reproducible sharding: a Feistel permutation of global row numbers.

Rows are numbered by rank of their id, the permutation scatters the numbers, and shard and slot follow by
division, so anyone who knows (number of rows, seed) can compute where row ``i`` went without reading data.

The domain is ``a * b`` with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``; alternating rounds add a keyed
polynomial hash of one half to the other, modulo ``a`` or ``b``. Values outside ``[0, n)`` are permuted again
(cycle walking); fewer than ``a`` values lie outside, so a walk is short. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

PRIME = 2**31 - 1
ROUNDS = 6
#: A walk longer than this has a chance below ``n ** (-WALK / 2)``; it then raises an error.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    digests = [hashlib.sha256(f"feistel:{seed}:{r}".encode()).digest() for r in range(ROUNDS)]
    return [tuple(1 + int.from_bytes(d[4 * i : 4 * i + 4], "big") % (PRIME - 1) for i in range(3)) for d in digests]


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute_number(x: int, n: int, seed: int) -> int:
    """The same permutation for one number in plain Python: where row ``x`` of ``n`` goes."""
    a, b = radices(n)
    while True:
        left, right = divmod(x, b)
        for r, (m, c, d) in enumerate(round_keys(seed)):
            t = ((left if r % 2 else right) * m + c) % PRIME
            v = (t * t % PRIME * t + d) % PRIME
            left, right = (left, (right + v) % b) if r % 2 else ((left + v) % a, right)
        x = left * b + right
        if x < n:
            return x


def permute(x: Column, n: int, seed: int) -> Column:
    """Position in ``[0, n)`` of row number ``x``: a bijection for each ``n`` and ``seed``."""
    a, b = radices(n)
    keys = F.array(*(F.struct(F.lit(r % 2 == 1).alias("odd"), *(F.lit(v).cast("long").alias(k) for k, v in zip("mcd", key, strict=True))) for r, key in enumerate(round_keys(seed))))
    p = F.lit(PRIME).cast("long")

    def turn(s: Column, k: Column) -> Column:
        t = (F.when(k["odd"], s["l"]).otherwise(s["r"]) * k["m"] + k["c"]) % p
        return F.transform(
            F.array(t),
            lambda t: F.transform(
                F.array((t * t % p * t + k["d"]) % p),
                lambda v: F.struct(F.when(k["odd"], s["l"]).otherwise((s["l"] + v) % F.lit(a).cast("long")).alias("l"), F.when(k["odd"], (s["r"] + v) % F.lit(b).cast("long")).otherwise(s["r"]).alias("r")),
            )[0],
        )[0]

    def once(y: Column) -> Column:
        start = F.struct(F.floor(y / F.lit(b)).cast("long").alias("l") if b < 2 else ((y - y % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (y % F.lit(b).cast("long")).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda y, _: F.when(y >= n, once(y)).otherwise(y))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 by ``order`` without a single-task window, and n.

    Rows are dealt by range; the counts of the ranges (one row each) are summed up and broadcast, and a
    window numbers the rows inside each range. Any range bounds give the same numbers.
    """
    spark = df.sparkSession
    ranged = materialize(df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    # one row for each range, at most spark.sql.shuffle.partitions of them: small by construction
    numbered = ranged.join(F.broadcast(before), "_part").withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1 + F.col("_before"))
    return numbered.drop("_part", "_before"), n


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row in exactly one shard and slot.

    Law ``rows``: shard = position % shards and slot = position // shards, so counts are at most one apart and
    slots are gapless from 0. A null text counts as empty (size 16, crc 0); null ids sort first; repeated rows
    get places of their own; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size"])
    at = numbered.withColumn("_at", permute(F.col("row_number"), max(n, 1), seed))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % shards).cast("int").alias("shard"), F.floor(F.col("_at") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = 40, seed: int = 7) -> str:
    """The same placement in SQL: ranks, the rounds as nested selects, the walk as a recursion, CRC-32 by its bits."""
    p = PRIME

    def rounds(source: str) -> str:
        q = f"select id, x // b as l, x % b as r, n, a, b from {source}"
        for k, (m, c, d) in enumerate(round_keys(seed)):
            half, other = ("l", "r") if k % 2 else ("r", "l")
            q = f"select id, {half}, t, {other}, n, a, b, (((t * t) % {p}) * t + {d}) % {p} as v from (select *, ({half} * {m} + {c}) % {p} as t from ({q}))"
            q = f"select id, {half}, ({other} + v) % {'b' if k % 2 else 'a'} as {other}, n, a, b from ({q})"
        return f"select id, l * b + r as x, n, a, b from ({q})"

    table = []
    for i in range(256):
        v = i
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    step = f"xor(crc >> 8, ([{', '.join(map(str, table))}]::BIGINT[])[1 + (xor(crc, v) & 255)])"
    digit = "(instr('0123456789ABCDEF', x[{}]) - 1)"
    octets = f"list_transform(regexp_extract_all(h, '..'), lambda x: 16 * {digit.format(1)} + {digit.format(2)})"
    return f"""
with recursive base as (
  select doc_id, coalesce(text, '') as text from documents),
size as (select count(*) as n, greatest(1, ceil(sqrt(count(*)))::BIGINT) as a from base),
numbered as (select doc_id as id, row_number() over (order by doc_id) - 1 as x from base),
walk as (
  select * from ({rounds("(select id, x, n, a, (n + a - 1) // a as b from numbered, size)")})
  union all
  select * from ({rounds("(select * from walk where x >= n)")})),
crcs as (
  select doc_id, octet_length(encode(text)) + 16 as size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), lambda crc, v: {step}), 4294967295::BIGINT) as text_crc32
  from (select doc_id, text, hex(encode(text)) as h from base))
select doc_id, size::BIGINT as size, text_crc32::BIGINT as text_crc32, 'rows' as law, (x % {shards})::INT as shard,
       (x // {shards})::BIGINT as slot, null::INT as grown_shard
from crcs join walk on id = doc_id where x < n
"""
