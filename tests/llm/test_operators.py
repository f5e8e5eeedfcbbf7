"""Every operator against a brute-force version, its SQL or an exact round trip, on tables with awkward rows."""

import collections
import hashlib
import random
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import boosting, components, decontamination, dom, fm_index, html_extraction, lyndon_sort, near_duplicates, packing, page_samples, quality, repeats, secret_scan, sharding, token_shards, vec, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "ré", "st", "un", "THE") for b in ("", "ta", "ver", "on", "ß", "x")]


def make_texts(n: int = 90) -> list[str | None]:
    rng = random.Random(4)
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    texts: list[str | None] = [None, "", "  \n ", "one", "two words", prose(4000)]
    shared = prose(60)
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15:
            texts.append(texts[-1])
        elif kind < 0.4:
            words = (rng.choice([t for t in texts if t and len(t) > 30])).split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        elif kind < 0.5:
            texts.append(f"{prose(20)} {shared} {prose(20)}\n{prose(3)}\n{prose(3)}")
        elif kind < 0.6:
            texts.append("same line\n" * 9 + prose(60) + " ### $$ %%")
        elif kind < 0.7:
            texts.append(f'{prose(9)} token = "{rng.choice(["ab12" * 8, "%032x" % rng.getrandbits(128)])}" AKIA{"A7" * 9} password: x secret=é password token: secret: abcdefg {"aB3" * 9} 𝄞 passwd="hunter22" {prose(3)}')
        else:
            texts.append(prose(rng.randrange(1, 300)))
    return texts


TEXTS = make_texts()
BENCH = [" ".join(TEXTS[5].split(" ")[100:140]), "two words", "", None, TEXTS[20], "nothing like it anywhere at all in these texts of ours here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], f"src{min(i % 7, 3)}", 5, "row", i) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, key long"
    return spark.createDataFrame(rows, schema).repartition(3, "key")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)], "item_id long, text string")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS, "lang": [["en", None, "fr"][i % 3] for i in range(len(TEXTS))], "source": [f"src{min(i % 7, 3)}" for i in range(len(TEXTS))]})
    benchmark = pd.DataFrame({"item_id": range(len(BENCH)), "text": BENCH})
    con.execute("create table documents as select * from documents")
    con.execute("create table benchmark as select * from benchmark")
    assert len(documents) and len(benchmark)
    return con


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def rows_sql(con, sql):
    found = con.execute(sql).fetch_df().astype(object)
    columns = sorted(found.columns)
    return columns, sorted((tuple(None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in found[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("operator, sql", [(lambda d, b: decontamination.report(d, b).drop("spans"), decontamination.oracle), (lambda d, b: quality.score_documents(d), quality.oracle), (lambda d, b: secret_scan.scan_documents(d), secret_scan.oracle), (lambda d, b: sharding.shard_documents(d), sharding.oracle)], ids=["decontamination", "quality", "secrets", "sharding"])
def test_matches_sql(docs, bench, duck, operator, sql):
    columns, want = rows_sql(duck, sql())
    got = operator(docs, bench)
    assert sorted(got.columns) == columns
    assert rows_of(got) == want


@pytest.mark.parametrize("operator", [lambda d, b: decontamination.report(d, b), lambda d, b: quality.score_documents(d), lambda d, b: secret_scan.scan_documents(d), lambda d, b: sharding.shard_documents(d), lambda d, b: repeats.find_repeats(d), lambda d, b: near_duplicates.group_documents(d), lambda d, b: packing.pack_documents(d), lambda d, b: quality.keep_documents(d), lambda d, b: near_duplicates.keep_one(d), lambda d, b: decontamination.remove_passages(d, b), lambda d, b: secret_scan.redact(d), lambda d, b: token_shards.materialize_order(d)])
def test_empty_table(docs, bench, operator):
    assert operator(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("operator", [lambda d, b: decontamination.report(d, b), lambda d, b: quality.score_documents(d), lambda d, b: secret_scan.scan_documents(d), lambda d, b: sharding.shard_documents(d), lambda d, b: repeats.find_repeats(d), lambda d, b: near_duplicates.group_documents(d)])
def test_null_columns_and_repeated_rows(spark, bench, operator):
    text = "kata " * 40
    rows = [(None, None, None, None), (None, text, None, "s"), (3, text, "en", None), (3, text, "en", None), (4, text, "en", "s"), (4, None, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert operator(df, bench).count() == len(rows)


def test_sharding_places_each_row_once(docs):
    got = sharding.shard_documents(docs).collect()
    n = len(TEXTS)
    places = sorted(r["slot"] * 40 + r["shard"] for r in got)
    assert places == list(range(n))
    for r in got:
        text = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        assert r["slot"] * 40 + r["shard"] == sharding.permute_number(r["doc_id"], n, 7)


@given(st.integers(1, 3000), st.integers(0, 9))
@settings(max_examples=30, deadline=None)
def test_permutation_is_a_bijection(n, seed):
    assert sorted(token_shards.permute_array(np.arange(n), n, seed)) == list(range(n))
    assert token_shards.permute_array(np.arange(1), n, seed)[0] == sharding.permute_number(0, n, seed)


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_orders(symbols):
    text = [*symbols, 0]
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert lyndon_sort.suffix_array(text) == want
    assert fm_index.suffix_order(np.array(text)).tolist() == want


@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_fm_index_finds_all(symbols, pattern):
    index = fm_index.FMIndex(np.array([*symbols, 0]), 4)
    low, high = index.search(np.array([[0] * (4 - len(pattern)) + pattern]), np.array([len(pattern)]))
    want = [i for i in range(len(symbols)) if symbols[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist()) == want


def brute_repeats(texts, length=50):
    first, out = {}, {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p : p + length], i) < i:
                hit[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(hit)))
        out[i] = (len(raw), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(raw, hit) if not h)).hexdigest())
    return out


def test_repeats_match_brute_force(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.find_repeats(docs).collect()}
    assert got == brute_repeats(TEXTS)
    assert any(v[1] and v[1] < v[0] for v in got.values())


def test_repeats_of_long_texts_in_parts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 700)
    column = [t.encode() for t in TEXTS if t and len(t) > 50]
    offs = np.cumsum([0, *map(len, column)])
    hashes, text, first, last, place = repeats.anchors(np.frombuffer(b"".join(column), np.uint8), offs)
    monkeypatch.undo()
    whole = repeats.anchors(np.frombuffer(b"".join(column), np.uint8), offs)
    windows = lambda h, t, a, b, p: sorted((w, x, y, z) for x, y, i, j, z in zip(h, t, a, b, p, strict=True) for w in range(i, j + 1))
    assert windows(hashes, text, first, last, place) == windows(*whole)


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(docs, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.group_documents(docs, k, percent).collect()}
    assert got == brute_components(TEXTS, k, percent)
    assert sum(not v[2] for v in got.values()) > 5


def test_near_duplicates_cross_blocks(spark, monkeypatch):
    """A chain of neighbours: links are found between members that are not linked with the smallest one, also when buckets are dealt into blocks."""
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rng = random.Random(1)
    words = [rng.choice(WORDS) + str(i) for i in range(60)]
    texts = []
    for i in range(25):
        texts.append(" ".join(words))
        words[(i * 7) % 60] = f"new{i}"
    order = list(range(25))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[o]) for i, o in enumerate(order)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.group_documents(df, 3, 85).collect()}
    assert got == {i: v[1] for i, v in brute_components([texts[o] for o in order], 3, 85).items()}


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    names = list(range(60))
    rng.shuffle(names)
    edges = [(min(a, b), max(a, b)) for a, b in zip(names[:40], names[1:40])] + [(min(a, b), max(a, b)) for a, b in zip(names[40:], names[41:])]
    got = {(r["node"], r["component"]) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, min(part)) for part in (names[:40], names[40:]) for x in part}


def public_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing_holds_each_id_once(docs):
    ids, seen, places = public_ids(TEXTS), collections.Counter(), collections.defaultdict(list)
    for r in packing.pack_documents(docs, length=256).collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), crc(piece), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        seen[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in enumerate(ids)}
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_splits_repeated_rows_and_long_texts(spark):
    """Neither copies of a row, null ids nor the pieces of one document fill one group."""
    rows = [(5, "same text here")] * 600 + [(None, f"text {i}") for i in range(600)] + [(6, "long text " * 9000)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=32, group_pieces=64).collect()
    for mine in ([r for r in out if r["doc_id"] == 5], [r for r in out if r["doc_id"] is None], [r for r in out if r["doc_id"] == 6]):
        groups = collections.Counter(r["sequence_id"] >> 32 for r in mine)
        assert len(groups) > 5 and max(groups.values()) < len(mine) / 3
    assert sum(r["doc_id"] == 5 for r in out) == 600
    assert sum(r["length"] for r in out if r["doc_id"] == 6) == [r["doc_tokens"] for r in out if r["doc_id"] == 6][0]


def test_first_fit_uses_leftmost_bin():
    bins, offsets = packing.first_fit(np.array([3, 5, 7, 2, 5, 3]), 10)
    assert bins.tolist() == [0, 1, 0, 2, 1, 2] and offsets.tolist() == [7, 0, 0, 3, 5, 0]


@pytest.mark.parametrize("text", ["a  b", "x 　y", "a\n\n b  c\t\td", "it's <|endoftext|> here", " lead", "tail ", "\x1c \x1d", "don't 12ab!! ?x", "é  ü  z"])
def test_chunked_encoding_is_exact(text):
    from tessera.llm.tokens import encoder

    texts = [text, "", text * 3, "plain words"]
    raw = [t.encode() for t in texts]
    ids, first = encoder().encode_block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [x[:-1] for x in public_ids(texts)]


def test_token_shards_round_trip(docs, spark, tmp_path):
    n = token_shards.write_shards(docs, f"file://{tmp_path}/s", length=64, slots=32)
    rows = token_shards.read_shards(spark, f"file://{tmp_path}/s", length=64, slots=32).collect()
    assert sorted(r["slot"] for r in rows) == list(range(n))
    assert all(r["shard"] == r["slot"] // 32 and crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in rows)
    ids, got = public_ids(TEXTS), collections.Counter()
    for r in rows:
        got.update(np.frombuffer(r["ids"], "<u4").tolist())
        mine = ids[r["doc_id"]][r["start"] : r["start"] + r["n_ids"]]
        assert np.frombuffer(r["ids"], "<u4")[: len(mine)].tolist() == mine
    assert got == collections.Counter(x for i in ids for x in i)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    big = "<p>" + "é\r\nWARC/1.1\r\n\r\n" * 4000 + "</p>"
    html = [None, "", "", big, "<p>x</p>", "<p>x</p>", big, "y" * 40_000, "<p>x</p>"] + ["z" * rng.randrange(40) for _ in range(30)]
    df = spark.createDataFrame([(100 - i, f"http://e/{i}\n" if i % 3 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    first = {}
    for i, h in enumerate(html):
        first[(h or "").encode()] = min(100 - i, first.get((h or "").encode(), 10**9))
    warc.write_archives(df, f"file://{tmp_path}/w")
    rows = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(rows) == len(html)
    for r in rows:
        payload = (html[100 - r["page_id"]] or "").encode()
        smallest = first[payload] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc.digest(payload))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if smallest else ("revisit", first[payload]))
        assert (r["payload"] == payload) if smallest else r["payload"] is None


def test_warc_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(5, "u", "<p>a</p>", "x")] * 3 + [(None, "u", "<p>a</p>", "x"), (7, None, "<p>a</p>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == {(5, 8, "response", None): 3, (None, 8, "response", None): 1, (7, 8, "revisit", 5): 1, (None, 0, "response", None): 1}
    assert warc.round_trip(df.limit(0)).collect() == []


def test_shards_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "same text")] * 4 + [(None, None), (None, "other"), (5, None)]
    got = token_shards.materialize_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), length=4, slots=3).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert sum(r["n_ids"] for r in got) == sum(len(x) for x in public_ids([t for _, t in rows]))


def page_accuracy(fitted, family, pages=40, seed=123, long=False):
    """(recall, noise) of blocks on pages that were not trained on."""
    rng, right, lost, wrong = np.random.default_rng(seed), 0, 0, 0
    while pages:
        html, main = page_samples.labelled_page(rng, family)
        nodes = dom.walk(dom.parse(html))
        if long and max(len(x.children) for x in nodes) <= 64:
            continue
        got = set(html_extraction.decode(nodes, fitted.scores([nodes])[0]))
        right, lost, wrong, pages = right + len(got & main), lost + len(main - got), wrong + len(got - main), pages - 1
    return right / (right + lost), wrong / (right + wrong)


@pytest.mark.parametrize("family, recall, noise", [("named", 0.98, 0.02), ("divs", 0.98, 0.02), ("table", 0.98, 0.02), ("portal", 0.97, 0.03), ("opaque", 0.75, 0.1)])
def test_html_held_out_accuracy(family, recall, noise):
    got = page_accuracy(html_extraction.model(), family)
    assert got[0] >= recall and got[1] <= noise


@pytest.mark.parametrize("family", ["divs", "table"])
def test_html_layouts_that_were_never_seen(family):
    recall, noise = page_accuracy(html_extraction.model(200, without=family), family)
    assert recall >= 0.95 and noise <= 0.05


def test_html_held_out_long_pages():
    recall, noise = page_accuracy(html_extraction.model(), "named", 12, 321, long=True)
    assert recall >= 0.98 and noise <= 0.02


def test_html_features_of_many_siblings():
    fitted = html_extraction.model()
    nodes = dom.walk(dom.parse("<article>" + "<p>One two.</p>" * 100 + "<h2>Three</h2>" * 25 + "</article>"))
    rows = dom.features(nodes, fitted.weights)
    same = {tag: {tuple(np.isclose(rows[x.order], share)) for x in nodes if x.tag == tag} for tag, share in (("p", 0.8), ("h2", 0.2))}
    assert all(any(np.all(list(flags), axis=0)) for flags in same.values())
    long = " ".join(f"util-{'xyz'[i % 3]}" for i in range(40))
    assert fitted.weights[dom.bucket("comments")] < -1 < fitted.weights[dom.bucket("article")]
    for tag in (f'<div class="{long}" id="comments">', f'<div class="{long} comments">'):
        node = dom.parse(f"{tag}Some text.</div>").children[0]
        assert dom.bucket("comments") in node.tokens


@pytest.mark.parametrize("page, n", [("<div>" * 20_000 + "x" + "</p>" * 20_000, 20_002), ("<h1>" * 20_000 + "<p>a" * 20_000, 60_001), ("<ul><li>a" * 20_000, 60_001), ("<table><tr><td>x" * 9000, 36_001)])
def test_html_parsing_is_linear_in_depth(page, n):
    began = time.process_time()
    assert len(dom.walk(dom.parse(page))) == n and time.process_time() - began < 5


def test_html_tags_close_what_they_should():
    shape = lambda x: x.text or [x.tag, *map(shape, x.children)]
    tree = dom.parse("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><p>f<h2>g<div>h</p>i<table><tr><td>j<td>k<tr><th>l</table><dl><dt>m<dd>n<dt>o</dl></section>")
    assert shape(tree) == ["#root", ["ul", ["li", "a", ["ul", ["li", "b"], ["li", "c"]], "d"], ["li", "e"]], ["p", "f"], ["h2", "g", ["div", "h", "i", ["table", ["tr", ["td", "j"], ["td", "k"]], ["tr", ["th", "l"]]], ["dl", ["dt", "m"], ["dd", "n"], ["dt", "o"]]]]]


def test_html_awkward_pages(spark):
    article = "<article><h1>A &amp; B</h1><p>One\n two<br>three.<p>Four, five &lt;six&gt;. Seven eight.</article>"
    pages = [(1, "u", f"<nav><ul><li><a href=/x>Home</a></ul></nav>{article}<footer>&copy; me</footer>"), (2, None, None), (3, "u", ""), (4, "u", "<p><div <<< &bogus; <!-- open"), (None, "u", "<script>var a='<p>no</p>'</script>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    df = df.unionByName(df.filter("page_id = 1"))
    rows = html_extraction.extract_pages(df).collect()
    assert len(rows) == 6
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in rows}
    assert got[1][0] == "A & B\nOne two three.\nFour, five <six>. Seven eight."
    assert got[2] == got[3] == got[None] == ("", 0)
    assert html_extraction.extract_pages(df.limit(0)).collect() == []


def test_decoding_is_consistent():
    nodes = dom.walk(dom.parse("<div><p>aa</p><p>bb</p></div><div><p>cc</p></div>"))
    score = np.array([9.0 if x.text in ("aa", "cc") else -0.5 if x.tag == "div" else -3.0 if x.text == "bb" else 1.0 for x in nodes])
    assert html_extraction.decode(nodes, score) == ["aa", "cc"]


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    fit = boosting.BoostedTrees(trees=60, depth=3).fit(x, y)
    z = rng.normal(size=(400, 4))
    assert ((fit.predict(z) > 0) == ((z[:, 0] > 0) ^ (z[:, 2] > 0.5))).mean() > 0.95


def test_passages_are_removed(docs, bench):
    cleaned = decontamination.remove_passages(docs, bench)
    assert cleaned.columns == docs.columns
    rows = {r["doc_id"]: r for r in cleaned.collect()}
    hit = {r["doc_id"]: r["contaminated"] for r in decontamination.report(docs, bench).collect()}
    assert hit[5] and len(rows[5]["text"]) < len(TEXTS[5])
    assert all(rows[i]["text"] == t for i, t in enumerate(TEXTS) if not hit[i])
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)


def test_decontamination_in_blocks(docs, bench, monkeypatch):
    want = rows_of(decontamination.report(docs, bench))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert rows_of(decontamination.report(docs, bench)) == want


def test_redaction(docs):
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan_documents(docs).collect()}
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        text, at, want = TEXTS[r["doc_id"]], 0, ""
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r["doc_id"]].split(",") if s):
            if a >= at:
                want += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["text"] == (text if text is None else want + text[at:])


def test_redaction_of_copied_secrets(spark):
    """A secret in copies of one text, or in texts of two owners, is no example; one in three texts of three owners is."""
    import corpus_pipeline

    names = ["copied", "thrice", "pair", "mixed", "known"]
    token = {k: f"{k}Q7" * 6 for k in names}
    rows = [("copied", "a", 0), ("copied", "b", 0), ("thrice", "a", 0), ("thrice", "b", 0), ("thrice", "c", 0), ("pair", "a", 0), ("pair", "b", 1), ("mixed", "a", 0), ("mixed", "b", 0), ("mixed", "c", 1), ("known", "a", 0), ("known", "b", 1), ("known", "c", 2)]
    text = [f"text {i} holds {token[k]} here" for k, _, i in rows]
    df = spark.createDataFrame([(n, t, s) for n, (t, (_, s, _)) in enumerate(zip(text, rows))], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scans(spark, df, "").collect()}
    assert got == {n: t if k == "known" else t.replace(token[k], "[SECRET]") for n, (t, (k, _, _)) in enumerate(zip(text, rows))}
    classes = {"copied": (1, 0, 0), "thrice": (1, 0, 0), "pair": (0, 1, 0), "mixed": (0, 1, 0), "known": (0, 0, 0)}
    scanned = secret_scan.scan_documents(df).collect()
    assert {r["doc_id"]: (r["n_live"], r["n_few"], r["n_example"]) for r in scanned} == {n: classes[k] for n, (k, _, _) in enumerate(rows)}


def test_many_repositories_of_one_owner_make_an_example(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "EXAMPLE_REPOS", 4)
    often, rarely = "oftenQ7" * 5, "rarelyQ7" * 5
    rows = [(i, f"text {i} holds {often} here", "a") for i in range(4)] + [(i, f"text {i} holds {rarely} here", "a") for i in range(4, 7)]
    got = secret_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: (r["spans"] != "", r["n_live"], r["max_repos"]) for r in got} == {i: (i > 3, int(i > 3), 3 * (i > 3)) for i in range(7)}


CLASHES = ["id", "_id", "_row", "_lang", "_quality", "_found", "_owner", "_repo", "_cands", "_t", "_s", "_limit", "_kept", "c0", "part", "key", "rep", "a b"]


@pytest.mark.parametrize("stage", ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_scans"])
def test_stages_keep_columns_of_any_name(spark, docs, bench, tmp_path, stage):
    """Values and schema stay, on null ids, null texts, repeated rows and clashing names; and on an empty table."""
    import corpus_pipeline

    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, ["en", None][i % 2], f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(None, TEXTS[40], None, None), (7, TEXTS[7], "en", "s1"), (7, TEXTS[7], "en", "s1"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASHES)) for i, r in enumerate(rows)], schema)
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = df.select("doc_id", "text", "lang", "source", "part")
    out = run(spark, df, str(tmp_path))
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = {r["part"]: r for r in out.collect()}
    want = {r["part"]: r["text"] for r in run(spark, plain, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    for i, r in enumerate(rows):
        if f"part{i}" in got:
            mine = got[f"part{i}"]
            assert (mine["doc_id"], mine["lang"], mine["source"], *(mine[c] for c in CLASHES)) == (r[0], r[2], r[3], *(f"{c}{i}" for c in CLASHES))
    assert stage in ("quality_rules", "near_dedup") or len(got) == len(rows)
    assert run(spark, df.limit(0), str(tmp_path)).collect() == []


def test_quality_limits_move_with_the_group(spark):
    """Each rule fires on what is out of line in its group, and lets the same text pass in a group where it is usual."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    prose = lambda n, size=6: [word(size) for _ in range(n)]

    def text(symbols=0, lines=0, repeats=0, size=6):
        words = prose(200 - symbols - repeats * 3, size) + ["#"] * 0
        words += ["$" + word(5) for _ in range(symbols)] + ["again and on"] * repeats
        rng.shuffle(words)
        return " ".join(words) + "".join(f"\nline {word(5)}" for _ in range(10)) + "\nthe same line here" * lines

    odd = {"symbols": dict(symbols=60), "dup_lines": dict(lines=8), "repeats": dict(repeats=20), "word_length": dict(size=14)}
    rows = []
    for rule, kind in odd.items():
        rows += [(f"{rule}-usual-{i}", text(), "en", "plain") for i in range(40)] + [(f"{rule}-odd", text(**kind), "en", "plain")]
        rows += [(f"{rule}-home-{i}", text(**kind), f"xx-{rule}", f"home-{rule}") for i in range(50)]
    got = {r["doc_id"]: r["kept"] for r in quality.score_documents(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    assert {k for k, v in got.items() if not v} == {f"{rule}-odd" for rule in odd}


def test_quality_keeps_clean_documents(docs):
    kept = {r["doc_id"] for r in quality.keep_documents(docs).collect()}
    scored = {r["doc_id"]: r for r in quality.score_documents(docs).collect()}
    assert kept == {i for i, r in scored.items() if r["kept"]}


def test_blocks_split_anywhere(monkeypatch):
    import pyarrow as pa

    column = pa.array(TEXTS).slice(2)
    whole = [x for _, _, buf, offs in vec.text_blocks(column) for x in zip(*near_duplicates.block_sets(buf, offs, 3)[:1])]
    monkeypatch.setattr(vec, "BLOCK_BYTES", 500)
    parts = [x for _, _, buf, offs in vec.text_blocks(column) for x in zip(*near_duplicates.block_sets(buf, offs, 3)[:1])]
    assert whole == parts


def brute_hits(texts, items, window=10):
    """(begin, end) in bytes of each maximal run of hit words of each text."""
    pattern = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    low = lambda t: re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())
    wanted = set()
    for t in items:
        w = re.findall(pattern, low(t))
        wanted |= {tuple(w[i : i + window]) for i in range(max(len(w) - window, 0) + 1)} if w else set()
    sizes, out = {len(w) for w in wanted}, []
    for t in texts:
        found = list(re.finditer(pattern, low(t)))
        hit = [False] * len(found)
        for n in sizes:
            for i in range(len(found) - n + 1):
                if tuple(m[0] for m in found[i : i + n]) in wanted:
                    hit[i : i + n] = [True] * n
        out.append([(found[i].start(), found[j - 1].end()) for i, j in ((m.start(), m.end()) for m in re.finditer("1+", "".join("01"[h] for h in hit)))])
    return out


def brute_redacted(texts, owners):
    """Texts without the base spans, and without tokens of fewer than three owners and twenty distinct texts that overlap no base span."""
    kinds = {
        "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        "access": (r"(AKIA[A-Z0-9]+)", 20), "hex": (r"([0-9a-f]+)", 24), "token": (r"([A-Za-z0-9+/_-]+)", 24),
    }
    found = [[(m.start(), m.end(), k, m[1]) for k, (p, n) in kinds.items() for m in re.finditer(p, t or "") if len(m[1]) >= n and (k != "token" or all(re.search(c, m[1]) for c in ("[0-9]", "[a-z]", "[A-Z]")))] for t in texts]
    owner, holders = {}, collections.defaultdict(set)
    for t, o in zip(texts, owners, strict=True):
        owner[t] = min(o, owner.get(t, o))
    for t, spans in zip(texts, found, strict=True):
        for s in spans:
            holders[s[3]].add(t)
    out = []
    for t, spans in zip(texts, found, strict=True):
        base = [s for s in spans if s[2] != "token"]
        few = lambda v: len({owner[x] for x in holders[v]}) < 3 and len(holders[v]) < 20
        cut = base + [s for s in spans if s[2] == "token" and few(s[3]) and not any(b[0] < s[1] and b[1] > s[0] for b in base)]
        new, at = "", 0
        for a, b, *_ in sorted(cut):
            if a >= at:
                new += t[at:a] + "[SECRET]"
            at = max(at, b)
        out.append(None if t is None else new + t[at:])
    return out


def test_pipeline(spark, tmp_path, bench):
    """All pieces, with texts, ids and places, against brute force of every stage but the verdict of the quality rules, which SQL checks."""
    import corpus_pipeline

    rng = random.Random(8)
    texts_of = TEXTS + [" ".join(rng.choice(WORDS) for _ in range(90)) + " " + t for t in TEXTS if t and "AKIA" in t]
    docs = spark.createDataFrame([(i, t, ["en", None, "fr"][i % 3], f"src{min(i % 7, 3)}", 5) for i, t in enumerate(texts_of)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    scored = {r["doc_id"]: r["kept"] for r in quality.score_documents(docs).collect()}
    kept = sorted(i for i, k in scored.items() if k)
    group = brute_components([texts_of[i] for i in kept], 5, 80)
    kept = [kept[i] for i, v in group.items() if v[2]]
    texts = []
    for raw, spans in zip([texts_of[i].encode() for i in kept], brute_hits([texts_of[i] for i in kept], BENCH), strict=True):
        at, parts = 0, []
        for a, b in spans:
            parts.append(raw[at:a])
            at = b
        texts.append(b"".join([*parts, raw[at:]]).decode())
    assert texts != [texts_of[i] for i in kept]
    cleaned = brute_redacted(texts, [f"src{min(i % 7, 3)}" for i in kept])
    assert cleaned != texts
    ids = dict(zip(kept, public_ids(cleaned), strict=True))
    assert {r["doc_id"] for r in out} == set(kept)
    seen, places = collections.Counter(), collections.defaultdict(list)
    for r in out:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (np.frombuffer(r["ids"], "<u4").tolist(), crc(piece), len(ids[r["doc_id"]])) == (piece, r["ids_crc32"], r["doc_tokens"])
        seen[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
