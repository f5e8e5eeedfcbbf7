"""Repair of conversations whose rows were lost, repeated or given to the wrong role.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles. Each row becomes one letter of a signature: its role if
that is known, in upper case if the row is truncated, or ``d`` if it must go. What a repair costs depends on the signature alone. Sorted
signatures are dealt by ranges, so that those with a common beginning meet; a task walks them as a trie, keeps the layers of
the dynamic program on the path from the root, goes back to the last shared letter, and computes each layer below once. The answer is
read at the terminal nodes.

A layer holds, for each state of the grammar, the cost of the best edits and its rank among the states in ASCII order of the
edits. Edits in a layer end with that of a row, not with an insertion, and all have as many letters other than ``I``: none can
begin another, so the order of two of them stays whatever follows, and ranks suffice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row. Which state each initial leads to.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FINAL = (0, 3)
#: Insertions before a row or at the end; three would come back to a state that one reaches.
MOST_INSERTED = 2
LETTERS = "suaxSUAXd"
_SPACE = " \t\n\x0b\f\r"
_BLOCK = 4096


def moves(letter: str) -> list[tuple[int, int, str, int]]:
    """(state, next state, edits, cost) of all ways to take a row of this letter, insertions before it included."""
    found = []
    for state in range(len(NEXT)):
        at, edits, cost = state, "", 0
        for _ in range(MOST_INSERTED + 1):
            found.append((state, at, edits + "D", cost + DELETE))
            if letter != "d":
                more = TRUNCATED if letter.isupper() else 0
                if letter.lower() in NEXT[at]:
                    found.append((state, NEXT[at][letter.lower()], edits + "K", cost + KEEP + more))
                found += [(state, NEXT[at][role], edits + "R", cost + REROLE + more) for role in "ua" if role in NEXT[at]]
            at, edits, cost = NEXT[at].get("u", NEXT[at].get("a")), edits + "I", cost + INSERT
    return found


def endings() -> list[tuple[int, str, int]]:
    """(state, insertions, cost) that end in a final state."""
    found = []
    for state in range(len(NEXT)):
        at = state
        for k in range(MOST_INSERTED + 1):
            if at in FINAL:
                found.append((state, "I" * k, k * INSERT))
            at = NEXT[at].get("u", NEXT[at].get("a"))
    return found


_MOVES = {letter: moves(letter) for letter in LETTERS}
_ENDINGS = endings()
#: A layer: (cost above the least, rank) of each state that can be reached, else None.
Layer = tuple[tuple[int, int] | None, ...]
_ROOT: Layer = ((0, 0), None, None, None)


class TrieWalk:
    """The dynamic program over sorted signatures; layers and what led to them lie on a stack, one for each letter of the path.

    Layers recur (costs count from the least), so a step is looked up by layer and letter once it is known.
    """

    def __init__(self):
        self.known: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}
        self.path = ""
        self.stack: list[tuple[Layer, int, tuple]] = [(_ROOT, 0, ())]
        self.layers = 0

    def _step(self, layer: Layer, letter: str) -> tuple[Layer, int, tuple]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, to, edits, cost in _MOVES[letter]:
            if layer[state] is not None:
                have, rank = layer[state]
                way = (have + cost, rank, edits, state)
                if to not in best or way < best[to]:
                    best[to] = way
        least = min(way[0] for way in best.values())
        order = sorted(best, key=lambda to: best[to][1:3])
        new = tuple((best[q][0] - least, order.index(q)) if q in best else None for q in range(len(NEXT)))
        return new, least, tuple((best[q][3], best[q][2]) if q in best else None for q in range(len(NEXT)))

    def __call__(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature that does not sort before the last one."""
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared : shared + _BLOCK] == self.path[shared : shared + _BLOCK] and shared + _BLOCK <= most:
            shared += _BLOCK
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.stack[shared + 1 :]
        for letter in signature[shared:]:
            layer, base, _ = self.stack[-1]
            key = (layer, letter)
            if key not in self.known:
                self.known[key] = self._step(layer, letter)
            new, more, back = self.known[key]
            self.stack.append((new, base + more, back))
            self.layers += 1
        self.path = signature
        layer, base, _ = self.stack[-1]
        cost, _, tail, state = min((layer[q][0] + c, layer[q][1], tail, q) for q, tail, c in _ENDINGS if layer[q] is not None)
        edits = [tail]
        for _, _, back in reversed(self.stack[1:]):
            state, piece = back[state]
            edits.append(piece)
        return base + cost, "".join(reversed(edits))


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures; the ranges of the sort keep shared beginnings together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = TrieWalk()
        for batch in batches:
            signature = batch.column(0).to_pylist()
            found = [walk(s) for s in signature]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    ranged = signatures.select("signature").distinct().repartitionByRange(partitions(signatures.sparkSession), "signature").sortWithinPartitions("signature")
    return ranged.mapInArrow(run, "signature string, cost long, audit string")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): the rows after the stated damage by CRC-32 of ``conv_id:turn``; a dropped row stays with alive false.

    A null counts as one space, in roles, texts and what is hashed.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    named = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("kind") != 0)))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("alive"))


def as_rows(conversations: DataFrame) -> DataFrame:
    """The columns of ``damage`` for rows that are to be repaired as they are."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), F.lit(True).alias("alive"))


def _order(*last: str) -> list[Column | str]:
    return [F.col("turn").asc_nulls_first(), "role", "digest", *last]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature): a row for each conversation, texts left behind.

    One shuffle by conversation serves the windows and the aggregation. Signatures are gathered in blocks of letters.
    """
    words = F.rtrim("text", F.lit(_SPACE))
    narrow = rows.select("conv_id", "turn", "role", "alive", F.md5(F.col("text").cast("binary")).alias("digest"), (words == "").alias("blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("open")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "alive", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marked = narrow.withColumn("again", F.row_number().over(same) > 1)
    line = Window.partitionBy("conv_id").orderBy(F.col("alive").desc(), *_order("again"))
    first = F.substring("role", 1, 1)
    blank, again, cut = F.col("blank"), ~F.col("blank") & F.col("again"), ~F.col("blank") & ~F.col("again") & F.col("open")
    role = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))
    letter = F.when(blank | again, F.lit("d")).when(cut, F.upper(role)).otherwise(role)
    placed = marked.select("conv_id", "alive", "turn", F.row_number().over(line).alias("at"), F.concat(F.lag(first).over(line), first).alias("step"), F.lag("turn").over(line).alias("before"), blank.alias("blank"), again.alias("again"), cut.alias("cut"), letter.alias("letter"))
    alive = F.col("alive")
    count = lambda c: F.sum(F.when(alive & c, 1).otherwise(0))
    illegal = (F.col("at") > 1) & ~F.col("step").isin("su", "ua", "au")
    block = placed.groupBy("conv_id", F.floor((F.col("at") - 1) / _BLOCK).alias("block")).agg(
        F.min(F.when(alive, F.col("turn"))).alias("low"), F.max(F.when(alive, F.col("turn"))).alias("high"),
        count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))).alias("turns"),
        count(F.col("blank")).alias("blank"), count(F.col("again")).alias("duplicate"), count(F.col("cut")).alias("truncated"), count(illegal).alias("illegal"),
        F.array_sort(F.collect_list(F.when(alive, F.struct("at", "letter")))).alias("letters"),
    )
    part = block.withColumn("letters", F.array_join(F.transform("letters", lambda x: x["letter"]), ""))
    total = lambda c: F.sum(c).alias(c)
    whole = part.groupBy("conv_id").agg(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *map(total, ("blank", "duplicate", "truncated", "illegal")), F.array_sort(F.collect_list(F.struct("block", "letters"))).alias("parts"))
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.array_join(F.transform("parts", lambda x: x["letters"]), "").alias("signature"))


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _with_audits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = materialize(signatures(rows), "signatures")
    audits = cheapest_edits(found)
    judged = found.join(audits, "signature").select("conv_id", *STATS, "audit")
    rows = rows.filter("alive").select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    return judged, rows


def _stream(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's verdict, then its rows in order, in one partition: what is needed to apply the edits row by row."""
    both = judged.withColumn("is_row", F.lit(False)).unionByName(rows.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_order())


class _Edits:
    """Applies an audit to the rows of a conversation as they come: yields (role, text) of what is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _put(self, role: str) -> str:
        self.state = NEXT[self.state][role[0]]
        return role

    def _needed(self) -> str:
        return self._put("user" if "u" in NEXT[self.state] else "assistant")

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._needed(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._put(role), text
        elif edit == "R":
            yield self._needed(), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def report(conversations: DataFrame, damaged: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conv_id, null among them.

    damaged: apply ``damage`` first. Rows go by turn, null first; rows of one turn by role, then by the MD5 of their text. A null role or
    text counts as one space; a role of another initial can only be given a new role or deleted, and an empty role has no
    initial. Repeated rows count as duplicates. A conversation without rows left has zeros, an empty audit and the digest of the empty
    string; an empty table gives an empty result; other columns are ignored. SHA-256 runs over the joined text, so a conversation is
    streamed by one task, row by row; only its audit is held.
    """
    judged, rows = _with_audits(damage(conversations) if damaged else as_rows(conversations))
    columns = ["conv_id", *STATS, "audit"]
    key = conversations.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key), *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest() -> str:
            add(edits.end())
            return hashed.hexdigest()

        def add(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal empty
            for role, text in lines:
                hashed.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False

        header, edits, hashed, empty, kind = None, None, None, True, None
        for batch in batches:
            out, kind = [], batch.schema
            is_row, role, text = (batch.column(kind.get_field_index(c)) for c in ("is_row", "role", "text"))
            heads = [batch.column(kind.get_field_index(c)) for c in columns]
            for i, row in enumerate(is_row.to_pylist()):
                if row:
                    add(edits.row(role[i].as_py(), text[i].as_py()))
                    continue
                if header is not None:
                    out.append((*header, digest()))
                header = tuple(c[i].as_py() for c in heads)
                edits, hashed, empty = _Edits(header[-1]), hashlib.sha256(), True
            if out:
                yield record(out, kind)
        if header is not None:
            yield record([(*header, digest())], kind)

    def record(out: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
        types = [kind.field(c).type for c in columns] + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*columns, "repaired_sha256"])

    return _stream(judged, rows).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired rows of ``conversations``, turns numbered from 0 in each conversation."""
    judged, rows = _with_audits(as_rows(conversations))
    key = conversations.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, conv, turn, kind = None, None, 0, None
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            conv_id, is_row, role, text, audit = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "is_row", "role", "text", "audit"))
            for i, row in enumerate(is_row.to_pylist()):
                lines = edits.row(role[i].as_py(), text[i].as_py()) if row else edits.end() if edits else ()
                for line in lines:
                    out.append((conv, turn, *line))
                    turn += 1
                if not row:
                    edits, conv, turn = _Edits(audit[i].as_py()), conv_id[i].as_py(), 0
            if out:
                yield record(out, kind)
        if edits is not None:
            if out := [(conv, turn + i, *line) for i, line in enumerate(edits.end())]:
                yield record(out, kind)

    def record(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])

    return _stream(judged, rows).mapInArrow(run, schema)


def oracle() -> str:
    """The same report in SQL: damage and faults by windows, the cheapest edits by a recursion over the letters of each signature."""
    table = []
    for i in range(256):
        v = i
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    step = f"xor(crc >> 8, ([{', '.join(map(str, table))}]::BIGINT[])[1 + (xor(crc, v) & 255)])"
    digit = "(instr('0123456789ABCDEF', x[{}]) - 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda x: 16 * {digit.format(1)} + {digit.format(2)})"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ways = ", ".join(f"({q}, '{letter}', {to}, '{edits}', {cost})" for letter in LETTERS for q, to, edits, cost in _MOVES[letter])
    ends = ", ".join(f"({q}, '{edits}', {cost})" for q, edits, cost in _ENDINGS)
    return f"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') as k from conversations),
kinds as (select *, xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), lambda crc, v: {step}), 4294967295::BIGINT) % 20 as kind from named),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [1, 2] else [1] end) as copy from kinds where kind <> 0),
seen as (
  select *, rtrim(text, {space}) as words, row_number() over (partition by conv_id, role, md5(text) order by turn nulls first, copy) > 1 as again from damaged),
placed as (
  select *, row_number() over line as pos, lag(role[1]) over line || role[1] as pair,
         case when words = '' then 'b' when again then 'r' when words[-1] not in ('.', '!', '?') then 't' else 'k' end as fault
  from seen window line as (partition by conv_id order by turn nulls first, role, md5(text), again)),
lettered as (
  select *, case when fault in ('b', 'r') then 'd' when fault = 't' then upper(initial) else initial end as letter
  from (select *, case when role[1] in ('s', 'u', 'a') then role[1] else 'x' end as initial from placed)),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'r') as duplicate,
         count(*) filter (fault = 't') as truncated, count(*) filter (pos > 1 and pair not in ('su', 'ua', 'au')) as illegal, string_agg(letter, '' order by pos) as signature
  from lettered group by conv_id),
whole as (
  select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(signature, '') as signature
  from (select distinct conv_id from conversations) o left join stats s on o.conv_id is not distinct from s.conv_id),
ways(state, letter, next, edits, cost) as (values {ways}),
ends(state, edits, cost) as (values {ends}),
layers as (
  select signature, 0 as n, 0 as state, {{'cost': 0, 'edits': ''}} as best from (select distinct signature from whole)
  union all
  select signature, l.n + 1, w.next, min({{'cost': best.cost + w.cost, 'edits': best.edits || w.edits}})
  from layers l join ways w on w.state = l.state and w.letter = signature[l.n + 1] where l.n < length(signature) group by signature, l.n, w.next),
answers as (
  select signature, min({{'cost': best.cost + e.cost, 'edits': best.edits || e.edits}}) as best
  from layers l join ends e on e.state = l.state where n = length(signature) group by signature),
edits as (
  select conv_id, unnest(string_split(best.edits, '')) as edit, generate_subscripts(string_split(best.edits, ''), 1) as place
  from whole join answers using (signature) where best.edits <> ''),
counted as (select *, count(*) filter (edit <> 'I') over (partition by conv_id order by place) as pos, count(*) filter (edit <> 'D') over (partition by conv_id order by place) as output from edits),
joined as (
  select c.conv_id, c.place, c.edit, c.output, p.role, p.text, max(case when c.edit = 'K' and c.output = 1 and p.role[1] = 's' then 1 else 0 end) over (partition by c.conv_id) as system
  from counted c left join placed p on c.conv_id is not distinct from p.conv_id and c.pos = p.pos and c.edit <> 'I' where c.edit <> 'D'),
lines as (
  select conv_id, string_agg(case when edit = 'K' then role when (output - system) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by place) as repaired
  from joined group by conv_id)
select w.conv_id, gaps::BIGINT as gaps, blank::BIGINT as blank, duplicate::BIGINT as duplicate, truncated::BIGINT as truncated, illegal::BIGINT as illegal,
       best.cost::BIGINT as cost, best.edits as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from whole w join answers using (signature) left join lines l on w.conv_id is not distinct from l.conv_id
"""
