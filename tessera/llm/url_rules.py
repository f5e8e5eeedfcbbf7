"""URL filtering: a list of rules first, association rules mined from labelled URLs for all others.

Tokens of a URL are its top-level domain, site, host, the words of the labels before the site, path segments (digits as ``#``),
extension, query keys and whether it has a fragment. FP-growth finds the token sets that are frequent in labelled URLs, with
and without the label ``bad``; the sets of a URL double with each token, so tokens beyond the ``ITEMS`` most common ones of any URL are
left to ``rare_rules``, which grows sets that hold one of them and loses no rule. A set becomes a rule if it is bad in at least
``CONFIDENCE`` percent of its URLs, ``support`` or more bad ones, and lies ``DEVIATIONS`` standard deviations above the share of bad
URLs; sets that hold another rule are pruned. Rules are looked up by an inverted index: each under its rarest token, the others
compared after that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, materialize, unmasked

#: (verdict, host, path) of the list.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A rule holds for at least so many bad URLs, and this share (1 / SHARE) of the labelled ones.
SUPPORT, SHARE = 20, 2000
CONFIDENCE, DEVIATIONS = 60, 5
#: Tokens of a labelled URL that go to FP-growth at most, the most common ones; rules with others are found level by level. The SQL
#: counts subsets of so many tokens alone.
ITEMS = 10
#: Rules and keys of URLs that are broadcast at most; more are joined by shuffle.
BROADCAST_RULES, BROADCAST_URLS = 10_000, 100_000
_BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = "://([^/?#]*)([^?#]*)"
_SCHEMA = "items array<string>, rarest string, n long, b long"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a URL with ``://``; else both are empty."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(whole, _PLACE, 1), _UPPER, _LOWER), F.regexp_extract(whole, _PLACE, 2)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules of equal length that both fit: the first in the list."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = F.endswith(F.concat(F.lit("."), host), F.lit(f".{name}")) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; empty for one without ``://``."""
    host, path = host_and_path(url)
    whole = F.coalesce(url.cast("string"), F.lit(""))
    labels = F.split(host, "[.]")
    named = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    words = F.flatten(F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.split(x, "-")))
    site = F.when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise("")
    query = F.regexp_extract(whole, "://[^?#]*[?]([^#]*)", 1)
    found = F.concat(
        named("tld", F.slice(labels, -1, 1)), named("site", F.array(site)), named("host", F.array(host)), named("word", words),
        named("path", F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")), named("ext", F.array(F.regexp_extract(path, r"[.]([a-z0-9]{1,8})\z", 1))),
        named("key", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))), named("has", F.array(F.when(F.regexp_like(whole, F.lit("://[^#]*#")), "fragment").otherwise(""))),
    )
    return F.sort_array(F.array_distinct(found))


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document is labelled: the path of a page has its document's id as the first number.

    A document is bad if any of its labels is toxic or of low quality.
    """
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    number = F.regexp_extract(host_and_path(F.col("url"))[1], "/([0-9]{1,18})([^0-9]|$)", 1)
    return pages.select("url", F.when(number != "", number.cast("long")).alias("doc")).distinct().join(bad, "doc").select("url", "bad")


def mine_rules(labelled: DataFrame, support: int = SUPPORT, share: int = SHARE, confidence: int = CONFIDENCE, deviations: float = DEVIATIONS, items: int = ITEMS) -> DataFrame:
    """(items, rarest, n, b): token sets that tell bad URLs, the rarest token of each, URLs that hold them, and bad ones among these.

    labelled: (url, bad). A URL counts once, as bad if any of its rows is; null URLs and labels are left out. Without enough
    bad URLs there are no rules. items: what FP-growth takes of a URL; the rules are the same for any.
    """
    spark = labelled.sparkSession
    known = materialize(labelled.filter("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad")).withColumn("tokens", tokens(F.col("url"))), "labelled_urls")
    total, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    least = max(support, -(-total // share))
    if bad < least:
        return spark.createDataFrame([], _SCHEMA)
    n, b = F.col("n"), F.col("b")
    above = (b * total - n * bad).cast("double")
    tells = (100 * b >= confidence * n) & (above > 0) & (above * above >= F.lit(deviations * deviations) * n.cast("double") * float(bad) * float(total - bad))
    each = known.select("url", "bad", F.explode("tokens").alias("token"))
    frequent = materialize(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("b")).filter(b >= least), "frequent_tokens")
    baskets = _baskets(each, frequent)
    rare = materialize(baskets.select(F.explode(F.slice("tokens", F.lit(items + 1), F.size("tokens"))).alias("token")).distinct(), "rare_tokens")
    some = not rare.isEmpty()
    if some:
        baskets = _baskets(each, frequent.join(rare, "token", "left_anti"))
    baskets = baskets.select(F.concat("tokens", F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(minSupport=min(1.0, (least - 0.5) / max(baskets.count(), 1)), itemsCol="items").fit(baskets)
    sets = materialize(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "frequent_sets")
    with_bad = sets.filter(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("b"))
    good = with_bad.join(sets.withColumnRenamed("freq", "n"), "items").filter(tells).select("items", F.col("items").alias("common"), "n", "b")
    if some:
        good = good.unionByName(rare_rules(each, frequent, rare, tells, least))
    good = materialize(good, "url_rules")
    # of a rule with rare tokens, parts that hold one are no rules: at most 2^ITEMS subsets each
    parts = good.filter(F.size("common") > 0).select("items", "common", F.expr("explode(sequence(1, shiftleft(1, size(common)) - 1))").alias("mask"))
    parts = parts.select("items", F.expr("filter(common, (x, i) -> shiftright(mask, i) % 2 = 1)").alias("part")).filter("size(part) < size(items)")
    redundant = parts.join(good.select(F.col("items").alias("part")), "part").select("items").distinct()
    minimal = good.join(redundant, "items", "left_anti")
    rarest = minimal.select("items", F.explode("items").alias("token")).join(frequent.select("token", n.alias("count")), "token").groupBy("items").agg(F.min_by("token", F.struct("count", "token")).alias("rarest"))
    return materialize(minimal.join(rarest, "items").select("items", "rarest", "n", "b"), "url_rules")


def _baskets(each: DataFrame, kept: DataFrame) -> DataFrame:
    """(bad, tokens) of each URL, of the tokens ``kept``, the most common first."""
    held = each.join(kept.select("token", (-F.col("n")).alias("rank")), "token").groupBy("url")
    return materialize(held.agg(F.max("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("held")).select("bad", F.col("held.token").alias("tokens")), "baskets")


def rare_rules(each: DataFrame, frequent: DataFrame, rare: DataFrame, tells: Column, least: int) -> DataFrame:
    """(items, common, n, b) of the sets that hold a token of ``rare`` and pass ``tells``, without those that hold a smaller one of these.

    common: the tokens of a set that are not rare. each: (url, bad, token); tells: of n and b.

    Sets grow by a token at a time. One that passes is done. So is one that lies in as many good URLs as a part of it: the part lies in
    at least as many bad ones, so it passes wherever the whole does, and the same holds with more tokens. Hence tokens that always come
    together, or one only with another, do not multiply: only sets remain in which every token keeps out good URLs of its own.
    """
    good_urls = F.col("n") - F.col("b")
    going_on = ~tells & (good_urls > 0)
    numbered = frequent.join(rare.withColumn("rare", F.lit(True)), "token", "left").withColumn("id", F.monotonically_increasing_id())
    # rare tokens have ids below zero, so that the first of a sorted set is rare
    numbered = materialize(numbered.select("token", "n", "b", F.when(F.col("rare"), -1 - F.col("id")).otherwise(F.col("id")).alias("id")), "numbered_tokens")
    urls = each.join(numbered.filter(going_on).select("token", "id"), "token").groupBy("url").agg(F.max("bad").alias("bad"), F.sort_array(F.collect_list("id")).alias("ids"))
    urls = materialize(urls.filter(F.col("ids")[0] < 0).select("bad", "ids"), "rare_baskets")
    # a row for each set in each URL, with the tokens that may follow
    longer = urls.select("bad", "ids", F.explode(F.filter("ids", lambda x: x < 0)).alias("id")).select("bad", F.filter("ids", lambda x: x > F.col("id")).alias("ids"), F.array("id").alias("items"))
    sets = numbered.filter("id < 0").select(F.array("id").alias("items"), "n", "b")
    found = [sets.filter(tells)]
    while going := (grown := sets.filter(going_on)).limit(BROADCAST_RULES + 1).count():
        items = grown.select("items")
        held = longer.join(F.broadcast(items) if going <= BROADCAST_RULES else items, "items", "left_semi").select("bad", "ids", "items")
        # single tokens are not written: all that may follow each of them grows with the square of a URL's tokens
        held = held if len(found) == 1 else materialize(held, "held_sets")
        longer = held.select("bad", "ids", "items", F.explode("ids").alias("id")).select("bad", F.filter("ids", lambda x: x > F.col("id")).alias("ids"), F.concat("items", F.array("id")).alias("items"))
        counted = longer.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("b")).filter(F.col("b") >= least)
        parts = counted.select("items", "n", "b", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part")).filter(F.col("part")[0] < 0)
        parts = parts.join(grown.select(F.col("items").alias("part"), good_urls.alias("in_part")), "part", "left")
        wider = F.coalesce(F.col("in_part") > good_urls, F.lit(False))
        sets = materialize(parts.groupBy("items", "n", "b").agg(F.bool_and(wider).alias("whole")).filter("whole").drop("whole"), "grown_sets")
        found.append(sets.filter(tells))
    named = reduce(DataFrame.unionByName, found).select("items", "n", "b", F.explode("items").alias("id")).join(numbered.select("id", "token"), "id")
    named = named.groupBy("items", "n", "b").agg(F.sort_array(F.collect_list("token")).alias("all"), F.sort_array(F.collect_list(F.when(F.col("id") >= 0, F.col("token")))).alias("common"))
    return named.select(F.col("all").alias("items"), "common", "n", "b")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) of the URLs that a rule matches: distinct, with the least rule that does, its tokens joined by ``+``."""
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    index = rules.select(F.col("rarest").alias("token"), F.col("items"))
    probes = urls.select("url").filter("url is not null").distinct().withColumn("tokens", tokens(F.col("url"))).select("url", "tokens", F.explode("tokens").alias("token"))
    hits = probes.join(F.broadcast(index) if few else index, "token").filter(F.size(F.array_except("items", "tokens")) == 0)
    return hits.groupBy("url").agg(F.min(F.array_join("items", "+")).alias("mined"))


def judge_urls(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): a row for each row of ``pages``.

    verdict: that of the longest listed rule that fits; else ``block`` if a mined rule matches, else ``allow``. mined: that rule,
    where no listed one fits. A null URL or one without ``://`` has an empty host and path and is allowed; null ids stay null;
    repeated rows are judged each; an empty table gives an empty result; other columns are ignored. rules: a list that is small
    enough for one expression.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": rule, "listed": verdict})
    found = materialize(match_rules(judged.filter("rule is null"), mined).select(F.md5(F.col("url").cast("binary")).alias("key"), "mined"), "matched_urls")
    few = found.limit(BROADCAST_URLS + 1).count() <= BROADCAST_URLS
    key = F.when(F.col("rule").isNull(), F.md5(F.col("url").cast("binary")))
    both = judged.withColumn("key", key).join(F.broadcast(found) if few else found, "key", "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def filter_pages(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all of their columns whatever their names."""
    wide, name = masked(pages)
    url = F.col(name[url_col]).cast("string")
    mined = mine_rules(labelled)
    rule, verdict = listed_rule(*host_and_path(url), rules)
    blocked = match_rules(wide.filter(rule.isNull()).select(url.alias("url")), mined).select(F.md5(F.col("url").cast("binary")).alias("_key"))
    key = F.when(rule.isNull(), F.md5(url.cast("binary")))
    kept = wide.filter(F.coalesce(verdict, F.lit("allow")) == "allow").withColumn("_of", key)
    return unmasked(kept.join(blocked, F.col("_of") == F.col("_key"), "left_anti"), pages)


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge_urls`` of all pages, with rules mined from the labels of their documents."""
    return judge_urls(pages, mine_rules(document_labels(pages, labels)))


def oracle() -> str:
    """The same verdicts in SQL: all subsets of each labelled URL's tokens are counted in place of FP-growth.

    It counts subsets of ``ITEMS`` tokens of a URL, as they double with each token; the operator has no such bound. Both agree
    where no labelled URL has more frequent tokens.
    """
    ordered = sorted(reversed(RULES), key=lambda r: -len(r[1] + r[2]))
    fits = [(what, name + start, f"ends_with('.' || host, '.{name}') and starts_with(path, '{start}')") for what, name, start in ordered]
    rule = "case " + " ".join(f"when {test} then '{text}'" for _, text, test in fits) + " end"
    listed = "case " + " ".join(f"when {test} then '{what}'" for what, _, test in fits) + " end"
    named = lambda kind, values: f"list_transform(list_filter({values}, lambda x: x <> ''), lambda x: '{kind}:' || x)"
    lists = [
        named("tld", "labels[-1:]"), named("site", "[case when len(labels) >= 2 then array_to_string(labels[-2:], '.') else '' end]"), named("host", "[host]"),
        named("word", "flatten(list_transform(labels[:greatest(len(labels) - 2, 0)], lambda x: string_split(x, '-')))"),
        named("path", "string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')"), named("ext", r"[regexp_extract(path, '[.]([a-z0-9]{1,8})\z', 1)]"),
        named("key", "list_transform(string_split(regexp_extract(url, '://[^?#]*[?]([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))"),
        named("has", "[case when regexp_matches(url, '://[^#]*#') then 'fragment' else '' end]"),
    ]
    return f"""
with split as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '{_PLACE}', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(url, ''), '{_PLACE}', 2) as path from pages),
judged as (select *, {rule} as rule, {listed} as listed from split),
urls as (
  select url, path, rule, list_sort(list_distinct({' || '.join(lists)})) as tokens from (select distinct url, host, path, rule, string_split(host, '.') as labels from judged where url is not null)),
bad as (select doc_id, max(coalesce(toxic = 1 or quality = 0, false)::INT) as bad from labels group by doc_id),
known as (select url, tokens, bad from urls join bad on doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1) as BIGINT)),
size as (select count(*) as total, coalesce(sum(bad), 0)::BIGINT as bad, greatest({SUPPORT}, (count(*) + {SHARE} - 1) // {SHARE}) as least from known),
each as (select url, bad, unnest(tokens) as token from known),
frequent as (select token, count(*) as n, sum(bad)::BIGINT as b from each group by token having sum(bad) >= (select least from size)),
ranked as (
  select url, e.bad, token, row_number() over (partition by url order by abs(b * total - n * size.bad) desc, token) as r
  from each e join frequent using (token), size),
baskets as (select url, max(bad) as bad, list_sort(list(token)) as items from ranked where r <= {ITEMS} group by url),
masks as (select url, bad, items, unnest(generate_series(1, (1 << len(items)) - 1)) as mask from baskets),
sets as (
  select list_filter(items, lambda x, i: (mask >> (i - 1)) % 2 = 1) as items, count(*) as n, sum(bad)::BIGINT as b from masks group by 1),
good as (
  select items, n, b from sets, size where b >= least and size.bad >= least and 100 * b >= {CONFIDENCE} * n and b * total > n * size.bad
  and (b * total - n * size.bad)::DOUBLE * (b * total - n * size.bad)::DOUBLE >= {DEVIATIONS * DEVIATIONS}::DOUBLE * n::DOUBLE * size.bad::DOUBLE * (total - size.bad)::DOUBLE),
minimal as (select items from good g where not exists (select 1 from good h where len(h.items) < len(g.items) and list_has_all(g.items, h.items))),
hits as (
  select url, min(array_to_string(items, '+')) as mined from urls, minimal where rule is null and list_has_all(tokens, items) group by url)
select page_id, host, path, rule, coalesce(listed, case when mined is not null then 'block' else 'allow' end) as verdict, case when rule is null then mined end as mined
from judged left join hits using (url)
"""
