"""Quality rules with adaptive thresholds.

Each text gets counts and four ratios (in thousandths). For each (language, source) a mergeable quantile
sketch of every ratio is kept: a histogram whose bins keep the ``LEAD`` leading bits of the value, so merging is
adding counts, the size is bounded by the number of bins, and a quantile is off by 1/64 at most.

The limit of a ratio is ``median + SPREADS * width``, where width is how far the group's 90 % quantile lies above its
median: at least one bin, and at most ``BOUND`` times the width of the group's language, so a source in which junk is
more than a tenth does not set its limit by it (the language bounds itself likewise by all rows). Groups of fewer than
``MIN_ROWS`` rows use the merged sketch of their language, and small languages that of all rows. A count is over when it
exceeds its limit by more than the rule's slack: a few events in a short text are no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import masked, materialize, unmasked

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_ROWS, SPREADS, BOUND, LEAD = 30, 4, 2, 7
#: Ratios: count, what it is divided by, and how many events beyond the limit are let pass.
RULES = {"symbols": ("n_symbols", "n_words", 3), "dup_lines": ("n_dup_lines", "n_lines", 2), "repeats": ("n_repeat_words", "n_words", 18), "word_length": ("word_chars", "n_words", 30)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offs])


def block_counts(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """``COUNTS`` of each text of a block."""
    n = len(offs) - 1
    starts, ends, first = vec.words(buf, offs, vec.NON_SPACE)
    inside = vec.NON_SPACE[buf]
    n_words = np.diff(first)
    word_chars = _per_text(inside & ((buf & 0xC0) != 0x80), offs)
    n_symbols = _per_text(_SYMBOL[buf], offs)

    breaks = np.flatnonzero(buf == 10)
    line_starts = np.sort(np.concatenate((offs[:-1], breaks + 1)))
    line_text = np.searchsorted(offs, breaks, "right") - 1
    line_ends = np.sort(np.concatenate((breaks, offs[1:])))
    text = np.sort(np.concatenate((np.arange(n), line_text)))
    word_at = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    full = word_at[line_ends] > word_at[line_starts]
    line_hash = vec.span_hashes(buf, line_starts[full], line_ends[full])
    n_lines = np.bincount(text[full], minlength=n)
    distinct, line_first = vec.distinct_per_text(line_hash, np.concatenate(([0], np.cumsum(n_lines))))
    n_dup_lines = n_lines - np.diff(line_first)

    windows, win_first = vec.window_hashes(vec.span_hashes(buf, starts, ends), first, 3, short=False)
    win_text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(win_first))
    key = (win_text << np.uint64(52)) | (windows >> np.uint64(12))
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(starts), bool)
    if len(again):
        marked = np.flatnonzero(again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key)
        at = marked + (first[:-1] - win_first[:-1])[win_text[marked].astype(np.int64)]
        for j in range(3):
            covered[at + j] = True
    n_repeat = np.diff(np.concatenate(([0], np.cumsum(covered)))[first])
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines]


def with_counts(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with a struct column ``_quality`` of ``COUNTS`` (null text: zeros)."""
    kept = [c for c in df.columns if keep_text or c != text_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("_quality", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, offs in vec.text_blocks(batch.column(text_col)):
                counts = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in block_counts(buf, offs)], COUNTS)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), counts], [*kept, "_quality"])

    return df.mapInArrow(run, schema)


def _ratio(rule: str) -> Column:
    a, b, _ = RULES[rule]
    return F.expr(f"(1000 * _quality.{a}) div greatest(_quality.{b}, 1)")


def _over(rule: str, limit: Column) -> Column:
    a, b, slack = RULES[rule]
    return F.expr(f"1000 * (_quality.{a} - {slack})") > limit * F.expr(f"greatest(_quality.{b}, 1)")


def _base_failed() -> Column:
    q = F.col("_quality")
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, metric, bin, n): sketches of the rows that pass the base rules; merge by adding ``n``."""
    long = counted.filter(~_base_failed()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _ratio(m).alias("v")) for m in RULES))).alias("x"))
    shift = f"greatest(length(bin(x.v)) - {LEAD}, 0)"
    binned = long.select("lang", "source", "x.metric", F.expr(f"shiftleft(shiftright(x.v, {shift}), {shift})").alias("bin"))
    return binned.groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, mid, width, step) of the sketches merged by ``keys``."""
    by = [*keys, "metric"]
    w = Window.partitionBy(*by)
    merged = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    cum = merged.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda share: F.min(F.when(F.col("cum") * 100 >= F.col("total") * share, F.col("bin")))
    found = cum.groupBy(*by).agg(at(50).alias("mid"), at(90).alias("high"), F.max("total").alias("total"))
    return found.select(*by, "total", "mid", (F.col("high") - F.col("mid")).alias("width"), F.expr(f"mid div {1 << (LEAD - 1)} + 1").alias("step"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, limit of each rule): the limits that hold for each group of the sketch."""
    names = ("total", "mid", "width", "step")
    level = [_quantiles(sketch, keys).withColumnsRenamed({c: f"{c}{i}" for c in names}) for i, keys in enumerate((["lang", "source"], ["lang"], []))]
    # joins of tables of one row for each group and rule; none of them sees a document
    df = level[0].join(level[1], ["lang", "metric"]).join(level[2], "metric")

    def limit(i: int) -> Column:
        width = F.col(f"width{i}") if i == 2 else F.least(f"width{i}", BOUND * F.greatest(f"step{i}", f"width{i + 1}"))
        return (F.col(f"mid{i}") + SPREADS * F.greatest(f"step{i}", width)).cast("long")

    held = F.when(F.col("total0") >= MIN_ROWS, limit(0)).when(F.col("total1") >= MIN_ROWS, limit(1)).otherwise(limit(2))
    return df.withColumn("limit", held).groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(m) for m in RULES))


def judge(counted: DataFrame, sketch: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``counted`` with boolean columns ``_base_failed`` and ``_kept``. A group without limits has no row that passes the base rules."""
    # a small file of known size, so Spark plans the join as a broadcast while it is under the threshold, and texts stay where they are
    found = materialize(limits(sketch), "limits").select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*RULES).alias("_limit"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = counted.join(found, (text(lang_col) == F.col("_l")) & (text(source_col) == F.col("_s")), "left")
    over = F.lit(False)
    for m in RULES:
        over = over | F.coalesce(_over(m, F.col("_limit")[m]), F.lit(False))
    return df.withColumn("_base_failed", _base_failed()).withColumn("_kept", ~F.col("_base_failed") & ~over).drop("_l", "_s", "_limit")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, counts, base_failed, kept), a row for each input row.

    A null or empty text has no words and fails; null languages and sources form groups of their own;
    repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = materialize(with_counts(narrow, "text", keep_text=False), "quality")
    judged = judge(counted, sketches(counted))
    q = F.col("_quality")
    return judged.select("doc_id", *(q[c].alias(c) for c in COUNTS[:5]), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all of their columns whatever their names. Texts are read twice and never shuffled while the limits are small.

    Null and empty texts go; null languages and sources form groups of their own; repeated rows are judged alike;
    an empty table stays empty.
    """
    df, name = masked(docs)
    text, lang, source = name[text_col], name[lang_col], name[source_col]
    sketch = materialize(sketches(with_counts(df.select(lang, source, text), text, keep_text=False), lang, source), "sketches")
    return unmasked(judge(with_counts(df, text), sketch, lang, source).filter("_kept"), docs)


def oracle() -> str:
    shift = f"greatest(length(bin(v)) - {LEAD}, 0)"
    limit = lambda i: f"mid{i} + {SPREADS} * greatest(step{i}, " + (f"width{i})" if i == 2 else f"least(width{i}, {BOUND} * greatest(step{i}, width{i + 1})))")
    level = lambda i, keys: f"""select {"".join(k + ", " for k in keys)}metric, max(total) as total{i}, min(bin) filter (cum * 100 >= total * 50) as mid{i},
             min(bin) filter (cum * 100 >= total * 90) - mid{i} as width{i}, mid{i} // {1 << (LEAD - 1)} + 1 as step{i}
      from (select *, sum(n) over (partition by {"".join(k + ", " for k in keys)}metric order by bin) as cum, sum(n) over (partition by {"".join(k + ", " for k in keys)}metric) as total
            from (select {"".join(k + ", " for k in keys)}metric, bin, count(*) as n from x group by all)) group by {"".join(k + ", " for k in keys)}metric"""  # noqa: E731
    pick = ", ".join(f"max(lim) filter (metric = '{m}') as {m}" for m in RULES)
    over = " or ".join(f"coalesce(1000 * ({a} - {slack}) > lim.{m} * greatest({b}, 1), false)" for m, (a, b, slack) in RULES.items())
    return rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i
      from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)),
win as (select *, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from w window p as (partition by doc_id order by i)),
rep as (select doc_id, i, w, w3 is not null and count(*) over (partition by doc_id, w, w2, w3) >= 2 as hit from win),
cov as (select doc_id, w, hit or coalesce(lag(hit, 1) over p, false) or coalesce(lag(hit, 2) over p, false) as hit
        from rep window p as (partition by doc_id order by i)),
words as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (hit) as n_repeat_words from cov group by 1),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
          from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
s as (select doc_id, lang, source, coalesce(n_words, 0)::BIGINT as n_words, coalesce(word_chars, 0)::BIGINT as word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT as n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT as n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words,
             coalesce(n_lines, 0)::BIGINT as n_lines
      from d left join words using (doc_id) left join lines using (doc_id)),
r as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
             1000 * n_symbols // greatest(n_words, 1) as symbols, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_lines,
             1000 * n_repeat_words // greatest(n_words, 1) as repeats, 1000 * word_chars // greatest(n_words, 1) as word_length from s),
x as (select lang, source, metric, (v >> {shift}) << {shift} as bin from
      (unpivot (select lang, source, symbols, dup_lines, repeats, word_length from r where not base_failed)
       on symbols, dup_lines, repeats, word_length into name metric value v)),
lim as (select lang, source, {pick} from
        (select lang, source, metric, case when total0 >= {MIN_ROWS} then {limit(0)} when total1 >= {MIN_ROWS} then {limit(1)} else {limit(2)} end as lim
         from ({level(0, ["lang", "source"])}) join ({level(1, ["lang"])}) using (lang, metric) join ({level(2, [])}) using (metric)) group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept
from r left join lim using (lang, source)
"""
