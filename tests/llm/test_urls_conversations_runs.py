"""URL rules, conversation repair and periodic runs against SQL and brute force, on tables with awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import conversation_repair, periodic_runs, url_rules


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def rows_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"{name}_frame", frame)
        con.execute(f"create table {name} as select * from {name}_frame")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=repr)


# URL rules


def make_pages():
    rng = random.Random(5)
    pages, labels = [], []
    for i in range(600):
        site = rng.choice(["good-news", "shop", "bad-casino", "blog.bad-casino", "www.plain"])
        lang = rng.choice(["en", "de", "fr"])
        tld = rng.choice(["org", "net", "com"])
        toxic = int("casino" in site and lang == "de") if rng.random() < 0.95 else 1
        pages.append((i, f"https://{site}.Example.{tld}/{lang}/{i}{rng.choice(['', '.html', '?page=2&ref=x', '#top'])}", "x"))
        if rng.random() < 0.8:
            labels.append((i, 1, toxic))
    odd = [None, "", "no scheme/en/4", "://", "http://com/es/3", "http://notexample.com/en/", "HTTP://WWW.EXAMPLE.COM/en/9", "http://m.example.com/en/9", "http://net/es/", "http://x.net/fr/1?a=//b", "http://x.net?/es/", "http://ÄB.net/es/" + "a/" * 3000, "http://a.org/\n/" + "9" * 40]
    pages += [(1000 + i, u, None) for i, u in enumerate(odd)] + [(None, pages[0][1], "y"), (3, pages[3][1], "x"), (3, pages[3][1], "x")]
    return pages, [*labels, (None, 1, 1), (7, None, None), (8, 0, None), (8, 1, 0)]


def test_url_rules_match_sql(spark):
    pages, labels = make_pages()
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, verdict string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_rules.report(df, marks)
    frames = {"pages": pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}), "labels": pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64")}
    assert rows_of(got) == rows_sql(url_rules.oracle(), **frames)
    found = {r["page_id"]: r for r in got.collect()}
    casino = [i for i, u, _ in pages[:600] if "casino" in u and "/de/" in u and ".org/" in u]
    assert casino and all(found[i]["verdict"] == "block" and "path:de+word:bad" == found[i]["mined"] for i in casino)
    clean = [i for i, u, _ in pages[:600] if "good-news" in u and ".org/" in u]
    assert clean and all(found[i]["verdict"] == "allow" for i in clean)
    assert found[1006]["rule"] == "www.example.com/en/" and found[1007]["verdict"] == "block" and found[1008]["rule"] == "net/es/"
    assert (found[1005]["rule"], found[1010]["rule"], found[1000]["verdict"]) == ("com/", None, "allow")


def test_url_rules_joined_by_shuffle_agree(spark, monkeypatch):
    pages, labels = make_pages()
    df, marks = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = rows_of(url_rules.report(df, marks))
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    monkeypatch.setattr(url_rules, "BROADCAST_URLS", 0)
    assert rows_of(url_rules.report(df, marks)) == want


def test_url_rules_without_rows_or_bad_urls(spark):
    pages, labels = make_pages()
    df, marks = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert url_rules.report(df.limit(0), marks).collect() == []
    for few in (marks.limit(0), marks.withColumn("toxic", url_rules.F.lit(0)).withColumn("quality", url_rules.F.lit(1)), marks.withColumn("toxic", url_rules.F.lit(1))):
        assert all(r["mined"] is None for r in url_rules.report(df, few).collect())


def test_pages_are_filtered_with_all_columns(spark):
    pages, labels = make_pages()
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, key string, _of int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = url_rules.filter_pages(df, url_rules.document_labels(df, marks))
    allowed = url_rules.report(df, marks).filter("verdict = 'allow'")
    assert kept.columns == df.columns
    assert sorted(repr(r["page_id"]) for r in kept.collect()) == sorted(repr(r["page_id"]) for r in allowed.collect())


def make_wide_pages():
    """URLs of up to 15 frequent tokens, bad where two of them come together or neither does (no sign alone), or few others are there (a weak sign)."""
    rng = random.Random(11)
    pages, labels = [], []
    for i in range(400):
        here = {k for k in "abcdefghi" if rng.random() < (0.5 if k in "be" else 0.8)}
        pages.append((i, f"http://{rng.choice('vw')}.wide.org/{i}/{'/'.join(f's-{k}' for k in sorted(here))}?k=1", "x"))
        labels.append((i, 1, int((("b" in here) == ("e" in here)) or (len(here - {*"be"}) < 6 and rng.random() < 0.6))))
    return pages, labels


def test_url_rules_of_urls_with_many_tokens_match_sql(spark, monkeypatch):
    pages, labels = make_wide_pages()
    frames = {"pages": pd.DataFrame(pages, columns=["page_id", "url", "html"]), "labels": pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"])}
    df, marks = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows_of(url_rules.report(df, marks))
    monkeypatch.setattr(url_rules, "ITEMS", 20)  # of the SQL alone: what the operator gives to FP-growth is bound above
    whole = url_rules.oracle()
    assert "r <= 20" in whole and got == rows_sql(whole, **frames)
    assert any(row[1] == "path:s-b+path:s-e" for row in got)


def test_url_rules_do_not_depend_on_what_fp_growth_takes(spark, monkeypatch):
    pages, labels = make_pages()
    df, marks = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled = url_rules.document_labels(df, marks)
    loose = {"support": 5, "confidence": 30, "deviations": 2.0}
    want = rows_of(url_rules.mine_rules(labelled, **loose))
    assert len(want) > 1
    for items, broadcast in ((0, 10_000), (3, 1)):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", broadcast)
        assert rows_of(url_rules.mine_rules(labelled, items=items, **loose)) == want


def test_url_rules_without_frequent_tokens(spark):
    labelled = spark.createDataFrame([(f"http://h{i}", True) for i in range(30)] + [(f"g{i}", False) for i in range(5)], "url string, bad boolean")
    assert [r["items"] for r in url_rules.mine_rules(labelled).collect()] == []


def test_url_rules_of_tokens_that_come_together_do_not_multiply(spark):
    deep = "/".join(f"d{k}x" for k in "abcdefghijklmnopqrstuvwxyz")  # 26 segments in the same URLs
    nested = [f"/n{'/n'.join('abcdefghijklmnopqrstuvwxyz'[: 1 + i % 26])}" for i in range(520)]  # each segment only with those before it
    urls = [(f"http://w.deep.org/{deep}/{i}{'/sale' if i % 2 else ''}", i % 2 == 1) for i in range(120)]
    urls += [(f"http://w.nest.org{path}/{i}{'/sale' if i % 7 == 0 else ''}", i % 7 == 0 and i % 3 > 0) for i, path in enumerate(nested)]
    urls += [(f"http://w.plain.org/{i}/sale", False) for i in range(120)]
    found = {tuple(r["items"]): (r["n"], r["b"]) for r in url_rules.mine_rules(spark.createDataFrame(urls, "url string, bad boolean")).collect()}
    alike = [f"path:d{k}x" for k in "abcdefghijklmnopqrstuvwxyz"] + ["host:w.deep.org", "site:deep.org"]
    assert {items for items in found if set(items) & set(alike)} == {tuple(sorted((x, "path:sale"))) for x in alike}
    assert all(found[tuple(sorted((x, "path:sale")))] == (60, 60) for x in alike)


# Conversation repair


def brute_repair(letters):
    """(cost, edits) over all edit sequences of at most the cost of deleting everything, checked by the pattern of roles."""
    best = (4 * len(letters), "D" * len(letters))

    def go(i, cost, edits, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(letters) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, edits))
        for role in "ua":
            if inserted < 3:
                go(i, cost + 3, edits + "I", roles + role, inserted + 1)
        if i < len(letters):
            letter = letters[i]
            go(i + 1, cost + 4, edits + "D", roles, 0)
            if letter != "d":
                more = 3 if letter.isupper() else 0
                if letter.lower() != "x":
                    go(i + 1, cost + more, edits + "K", roles + letter.lower(), 0)
                for role in "ua":
                    go(i + 1, cost + 3 + more, edits + "R", roles + role, 0)

    go(0, 0, "", "", 0)
    return best


@given(st.lists(st.text(conversation_repair.LETTERS, max_size=5), max_size=8))
@settings(max_examples=150, deadline=None)
def test_trie_walk_matches_brute_force(signatures):
    walk = conversation_repair.TrieWalk()
    for signature in sorted(signatures):
        assert walk(signature) == brute_repair(signature)


def test_trie_walk_computes_shared_beginnings_once():
    walk = conversation_repair.TrieWalk()
    beginning = "ua" * 5000
    assert [walk(s) for s in (beginning, beginning + "u", beginning + "ua")] == [(0, "K" * 10000), (3, "K" * 10001 + "I"), (0, "K" * 10002)]
    assert walk.layers == 10002


def make_conversations():
    rng = random.Random(8)
    rows = []
    for conv in range(120):
        turn = 0
        for i in range(rng.randrange(1, 9)):
            role = "system" if i == 0 and rng.random() < 0.3 else ["user", "assistant"][i % 2] if rng.random() < 0.9 else rng.choice(["tool", "", None, "User", "user"])
            text = rng.choice(["Well. yes", "Fine!", "Is it?", " \n\t", "", None, "No end", "Same text.", "ends so. \n", "é ", "\x0b x! \x0c"])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 0, 3])
    rows += [(500, 3, "user", "twice."), (500, 3, "user", "twice."), (500, 3, "user", "again."), (501, None, None, None)]
    rows += [(600, i, ["user", "assistant"][i % 2], f"line {i}.") for i in range(9000)]
    return rows


def test_conversations_match_sql(spark):
    rows = make_conversations()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, at int").repartition(5)
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert rows_of(conversation_repair.report(df)) == rows_sql(conversation_repair.oracle(), conversations=frame)


def damaged_rows(conv, rows):
    """The rows of one conversation after damage, in order: a row at a time, by the rules as they are stated."""
    out = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_conversations_match_brute_force(spark):
    rows = [r for r in make_conversations() if r[0] is not None and r[0] < 120]
    seen, once = set(), []
    for r in rows:  # rows of one turn have no stated order: one each
        if (r[0], r[1]) not in seen:
            once.append(r)
            seen.add((r[0], r[1]))
    got = {r["conv_id"]: r for r in conversation_repair.report(spark.createDataFrame(once, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in once}:
        left = damaged_rows(conv, [r[1:] for r in once if r[0] == conv])
        letters, before = "", set()
        for _, role, text in left:
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "d" if not words or (role, text) in before else role[:1] if role[:1] in list("sua") else "x"
            letters += fault.upper() if fault != "d" and words[-1] not in ".!?" else fault
            before.add((role, text))
        cost, audit = brute_repair(letters)
        turns = [t for t, _, _ in left if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        lines, at, roles = [], 0, ["user", "assistant"] * len(audit)
        for edit in audit:
            if edit == "I":
                lines.append(f"{roles[len(lines) - (bool(lines) and lines[0].startswith('s'))]}:")
                continue
            _, role, text = left[at]
            at += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
            elif edit == "R":
                lines.append(f"{roles[len(lines) - (bool(lines) and lines[0].startswith('s'))]}:{text}")
        want = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert tuple(got[conv][c] for c in ("gaps", "illegal", "cost", "audit", "repaired_sha256")) == want, conv


def test_conversations_empty_and_repaired_ones_stay(spark):
    df = spark.createDataFrame(make_conversations(), "conv_id long, turn long, role string, text string")
    assert conversation_repair.report(df.limit(0)).collect() == []
    fixed = conversation_repair.repair(df)
    again = conversation_repair.report(fixed, damaged=False).collect()
    initials = {}
    for r in fixed.orderBy("conv_id", "turn").collect():
        initials[r["conv_id"]] = initials.get(r["conv_id"], "") + r["role"][0]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in initials.values())
    assert sum(r["illegal"] for r in again) == 0 and 600 in initials


# Periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
@settings(max_examples=80, deadline=None)
def test_runs_match_brute_force(texts):
    assert periodic_runs.find_runs(texts) == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


@given(st.lists(st.integers(0, 2), min_size=1, max_size=150))
@settings(max_examples=80, deadline=None)
def test_extensions_match_brute_force(symbols):
    keys = periodic_runs.np.array([*symbols, 99])
    n = len(symbols)
    i, j = (x.ravel() for x in periodic_runs.np.mgrid[:n, :n])
    i, j = i[i != j], j[i != j]
    want = [next(k for k in range(n + 1) if symbols[a + k : a + k + 1] != symbols[b + k : b + k + 1] or a + k >= n or b + k >= n) for a, b in zip(i, j, strict=True)]
    if len(i):
        assert periodic_runs.Extension(keys)(i, j).tolist() == want


def test_runs_of_pairs_asked_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    texts = [[0] * 50, [0, 1] * 30, [], [0, 1, 2] * 5 + [0, 0, 0, 0, 0, 0]]
    assert periodic_runs.find_runs(texts) == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "bé", "c.", "𝄞", "the", "x y"])
    made = [None, "", " \n\x0b\x0c\r\t ", "one", "a a a a a", "a a a a a a", "a b " * 4, "a\tb\nc " * 40 + "end"]
    made += [" ".join(word() for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    made += ["x y z " * rng.randrange(1, 30) + " ".join(word() for _ in range(20)) for _ in range(20)]
    return [*enumerate(made), (None, "a " * 30), (5, "a a a a a a"), (5, "a a a a a a")]


def test_run_report_matches_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, 9, "s") for i, t in texts], "doc_id long, text string, length long, start string").repartition(4)
    got = periodic_runs.report_runs(df)
    names = [c.split()[0] for c in periodic_runs.SCHEMA.split(", ")]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((brute_report(i, t) for i, t in texts), key=repr)
    assert periodic_runs.report_runs(df.limit(0)).collect() == []


def test_runs_of_texts_beyond_a_block(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(9)) for _ in range(300_000)) + " p q r" * 50_000
    same = "w " * 400_000
    got = {r["doc_id"]: r for r in periodic_runs.report_runs(spark.createDataFrame([(1, long), (2, same), (3, "a b c")], "doc_id long, text string"), damage=False).collect()}
    assert (got[1]["start"], got[1]["length"], got[1]["period"]) == (300_000, 150_000, 3)
    assert (got[2]["n_runs"], got[2]["length"], got[2]["period"], got[2]["collapsed_sha256"]) == (1, 400_000, 1, hashlib.sha256(b"w").hexdigest())
    assert got[3]["n_runs"] == 0


def test_documents_are_collapsed(spark):
    df = spark.createDataFrame([(1, "so it goes " * 9 + "on\nand on", 7), (2, None, 8)], "id long, text string, doc_id long")
    assert [tuple(r) for r in periodic_runs.collapse_documents(df).orderBy("id").collect()] == [(1, "so it goes on and on", 7), (2, None, 8)]
