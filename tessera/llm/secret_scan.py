"""Secret scans with corpus-wide ownership frequency, by DataFrame functions alone.

Patterns give candidates with their places; the places follow from the lengths of the matches and of the
pieces between them. Hashes of candidate values are counted over the corpus by distinct owners and repositories, over
distinct texts: copies of one text have one owner and one repository together (the smallest). A value of
``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOS`` repositories or more is a widely copied example; of the others, a value of
one owner looks live, and the rest (``few``) is treated like it. Tokens of mixed letters and digits become spans of their own
beside the base kinds unless they are examples. Repository and owner are columns; in the query and the pipeline a document
stands for a repository and its source for the owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import masked, materialize, unmasked

EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
_CASED = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
#: kind: pattern, group of the value, least length of the value. Runs of fixed classes carry their least length in the pattern.
KINDS = {
    "assign": (rf"""({_CASED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9+/_-]{24,}", 0, 24),
}
BASE = ["assign", "access", "hex"]


def _candidate(kind: str):
    def of(x: Column) -> Column:
        v = x["v"]
        mixed = v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") if kind == "token" else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), F.when(mixed, F.length(v)).otherwise(0).alias("value_size"), F.xxhash64(v).alias("value"))

    return of


def _candidates(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_cands``: (kind, characters before since the last match, of the match, of the value, hash of the value)."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumns({f"_m_{k}": F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for k, (p, _, _) in KINDS.items()})
    parts = []
    for k, (p, group, _) in KINDS.items():
        m = F.col(f"_m_{k}")
        values = F.regexp_extract_all("_t", F.lit(p), F.lit(group)) if group else m
        zipped = F.arrays_zip(F.split("_t", p, -1).alias("p"), m.alias("m"), values.alias("v"))
        rows = F.transform(zipped, _candidate(k))
        empty = F.expr("cast(array() as array<struct<kind:string,gap:int,size:int,value_size:int,value:bigint>>)")
        parts.append(F.when(F.size(m) > 0, F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(empty))
    return df.withColumn("_cands", F.concat(*parts)).drop("_t", *(f"_m_{k}" for k in KINDS))


def _spans(cands: DataFrame) -> DataFrame:
    """Spans of all candidates but token examples and tokens that overlap a base span: (_row, kind, begin, end, base, n_owners, n_repos, example)."""
    w = Window.partitionBy("_row", "kind").orderBy("i")
    rows = cands.select("_row", "_repo", "_owner", "_copy", F.posexplode("_cands").alias("i", "c")).select("_row", "_repo", "_owner", "_copy", "i", "c.*")
    least = F.create_map(*(F.lit(x) for k, (_, _, n) in KINDS.items() for x in (k, n)))
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(w)).withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.filter(F.col("value_size") >= least[F.col("kind")]).withColumn("base", F.col("kind").isin(*BASE))
    # equal texts hold the same values, so the smallest owner and repository of a value's copies are those of the text
    texts = rows.groupBy("value", "_copy").agg(F.min("_owner").alias("_owner"), F.min("_repo").alias("_repo"))
    owners = texts.groupBy("value").agg(F.count_distinct("_owner").alias("n_owners"), F.count_distinct("_repo").alias("n_repos"))
    owners = owners.withColumn("example", (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS))
    # a widely copied value may be a hot key: Spark splits such a partition of the left side (adaptive skew join)
    rows = rows.join(owners, "value")
    place = Window.partitionBy("_row").orderBy("begin", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("begin"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"_before": before, "_after": after})
    apart = F.coalesce(F.col("_before") <= F.col("begin"), F.lit(True)) & F.coalesce(F.col("_after") >= F.col("end"), F.lit(True))
    return rows.filter(F.col("base") | (apart & ~F.col("example"))).select("_row", "kind", "begin", "end", "base", "n_owners", "n_repos", "example")


def _tagged(docs: DataFrame, text_col: str, repo: Column, owner: Column) -> DataFrame:
    named = docs.withColumns({"_row": F.monotonically_increasing_id(), "_repo": F.coalesce(repo.cast("string"), F.lit("")), "_owner": F.coalesce(owner.cast("string"), F.lit("")), "_copy": F.xxhash64(text_col)})
    return _candidates(named, F.col(text_col))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_few, n_example, max_owners, max_repos), a row for each input row.

    Places are code points, end exclusive. n_live, n_few and n_example count the spans by the class of their value; max_owners and
    max_repos are the largest counts among them (0 without spans). A null or empty text has no spans; null owners are one owner, and null
    repositories one repository; repeated rows are reported as often as they occur; an empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"))
    tagged = materialize(_tagged(narrow, "text", F.col("repo"), F.col("owner")).select("_row", "doc_id", "_repo", "_owner", "_copy", "_cands"), "secrets")
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    mine = _spans(tagged.filter(F.size("_cands") > 0)).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("begin", order.alias("k"), "kind", "end", "base"))).alias("s"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.count_if(~F.col("example") & (F.col("n_owners") == 1)).alias("n_live"),
        F.count_if(~F.col("example") & (F.col("n_owners") > 1)).alias("n_few"),
        F.count_if("example").alias("n_example"),
        F.max("n_owners").alias("max_owners"),
        F.max("n_repos").alias("max_repos"),
    )
    counts = [*(f"n_{k}" for k in [*BASE, "live", "few", "example"]), "max_owners", "max_repos"]
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")
    found = mine.select("_row", *counts, text(F.filter("s", lambda x: x["base"])).alias("base"), text(F.col("s")).alias("spans"))
    out = tagged.select("_row", "doc_id").join(found, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *map(zero, counts[:3]), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *map(zero, counts[3:]))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``docs`` with every span (base kinds, and tokens that are no examples) replaced by ``mark``; n_chars, if there, is counted anew.

    All rows and columns stay, whatever their names; null texts stay null; repeated rows are cut alike; an empty table stays empty. The
    scanned table is written once to the shared folder; only rows with spans are joined and rebuilt.
    """
    df, name = masked(docs)
    tagged = materialize(_tagged(df, name[text_col], F.col(name[repo_col]), F.col(name[owner_col])), "secrets")
    spans = _spans(tagged.filter(F.size("_cands") > 0)).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_s"))
    hit = tagged.filter(F.size("_cands") > 0).join(spans, "_row", "left")
    text = F.col(name[text_col])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.when(s["begin"] >= acc["at"], F.array(text.substr((acc["at"] + 1).cast("int"), (s["begin"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    rebuilt = F.aggregate("_s", start, cut, lambda a: F.concat(F.array_join(a["out"], ""), text.substr((a["at"] + 1).cast("int"), F.length(text))))
    hit = hit.withColumn(name[text_col], F.when(F.col("_s").isNotNull(), rebuilt).otherwise(text))
    out = unmasked(tagged.filter(F.size("_cands") == 0).select(*df.columns).unionByName(hit.select(*df.columns)), docs)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def oracle() -> str:
    parts = " union all ".join(
        f"""select doc_id, source, '{k}' as kind, {i} as k, {n} as least, unnest(regexp_extract_all(text, {p!r}, 0)) as m,
            unnest(regexp_extract_all(text, {p!r}, {g})) as v, unnest(regexp_split_to_array(text, {p!r})) as p,
            generate_subscripts(regexp_split_to_array(text, {p!r}), 1) as i from d"""
        for i, (k, (q, g, n)) in enumerate(KINDS.items())
        for p in [_Sql(q)]
    )
    return rf"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
x as ({parts}),
y as (select *, sum(length(p) + length(m)) over (partition by doc_id, kind order by i) as e from x where m is not null),
z as (select *, e - length(m) as b, kind <> 'token' as base from y where length(v) >= least
      and (kind <> 'token' or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')))),
o as (select v, count(distinct owner) as n_owners, count(distinct repo) as n_repos
      from (select v, text, min(z.source) as owner, min(doc_id::VARCHAR) as repo from z join d using (doc_id) group by all) group by 1),
f as (select z.*, n_owners, n_repos, n_owners >= {EXAMPLE_OWNERS} or n_repos >= {EXAMPLE_REPOS} as example from z join o using (v)
      where base or (n_owners < {EXAMPLE_OWNERS} and n_repos < {EXAMPLE_REPOS}
                     and not exists (select 1 from z q where q.base and q.doc_id = z.doc_id and q.b < z.e and q.e > z.b))),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
             count(*) filter (kind = 'hex') as n_hex, count(*) filter (not example and n_owners = 1) as n_live,
             count(*) filter (not example and n_owners > 1) as n_few, count(*) filter (example) as n_example,
             max(n_owners) as max_owners, max(n_repos) as max_repos,
             string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' order by b, k) filter (base) as bs,
             string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' order by b, k) as spans from f group by 1)
select doc_id, coalesce(n_assign, 0)::BIGINT as n_assign, coalesce(n_access, 0)::BIGINT as n_access, coalesce(n_hex, 0)::BIGINT as n_hex,
       sha256(coalesce(bs, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::BIGINT as n_live,
       coalesce(n_few, 0)::BIGINT as n_few, coalesce(n_example, 0)::BIGINT as n_example,
       coalesce(max_owners, 0)::BIGINT as max_owners, coalesce(max_repos, 0)::BIGINT as max_repos
from d left join g using (doc_id)
"""


class _Sql(str):
    """A string whose repr is an SQL literal."""

    def __repr__(self) -> str:
        return "'" + self.replace("'", "''") + "'"
