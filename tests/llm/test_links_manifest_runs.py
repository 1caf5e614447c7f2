"""Url filters, Merkle manifests and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import merkle, periods, redirects
from codelake.llm.oracle import OP11, OP12
from codelake.llm.registry import op11_url_filter, op12_merkle_manifest, op13_periodic_runs
from codelake.llm.text import Block

LOWER = {i: i + 32 for i in range(65, 91)}
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def against_sql(spark, tmp_path, name, df, query, sql):
    duckdb = pytest.importorskip("duckdb")
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    got = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))
    return got


# Redirect equivalence


def site(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :], re.S).group()


def rule_of(url, rules):
    host, path = site(url)
    fits = [
        (len(h + p), v == "allow", len(h), h + p) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host
    ]
    return max(fits, default=None)


def canonical(href):
    return f"<html><head><link rel='canonical' href=\"{href}\"></head>"


def refresh(href):
    return f'<META HTTP-EQUIV="Refresh" content="0; URL={href}">'


PAGES = [
    (1, "https://a.com/de/1", "<p>"), (2, "http://b.net/x", canonical("https://a.com/de/1#top")),
    (3, "http://c.net/y?q=1&r=2", refresh("http://b.net/x")), (4, "http://d.org/z", refresh("//c.net/y?q=1&amp;r=2")),
    (5, "HTTP://E.net/Dir/page", canonical("other")), (6, "http://e.net/Dir/other", None), (7, "http://e.net/Dir/page#frag", ""),
    (8, None, canonical("http://a.com/de/1")), (9, "no address", "<link rel=canonical href=/x>"), (10, "", None),
    (None, "http://b.net/x", "<!-- <link rel=canonical href='http://a.com/de/2'> -->"), (12, "http://f.net/x", "<!-- " + canonical("http://a.com/de/2") + "-->"),
    (13, "http://g.net", canonical("?a=b")), (14, "http://g.net?a=b", "<link rel='nofollow canonical' href='mailto:x@y'>"),
    (15, "http://h.example.org/es/2", "<link/rel=alternate href='http://a.com/de/1'>"), (16, "http://EXAMPLE.org/en/19?x#y", None),
    (17, "http://notexample.org/en/1", canonical("http://a.com/de/1")), (18, "http://x.com/fr", None), (19, "http://org/", None),
    (20, "http://org", None), (21, "http://i.net/a/b", canonical("/de/1")), (1, "https://a.com/de/1", "<p>"),
    (22, "http://j.net/" + "p/" * 20000, canonical("../up")), (23, "a://b://c/d", None), (24, "http://k.net/1", refresh("http://never.com/de/seen")),
    (25, "http://k.net/2", refresh("http://never.com/de/seen")),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "x", "y", True, "z") for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, allowed boolean, node string").repartition(3)


def test_url_filter(spark, pages, tmp_path):
    got = against_sql(spark, tmp_path, "pages", pages, op11_url_filter, OP11)
    verdicts = {(r["page_id"], r["verdict"]) for r in got.collect()}
    for i in (1, 2, 3, 8, 12, 16, 15, 24, 25, None):
        assert (i, "block" if i != 12 else "allow") in verdicts
    for i in (4, 5, 6, 7, 9, 10, 13, 14, 17, 18, 19, 20, 21, 22, 23):
        assert (i, "allow") in verdicts
    want = sorted((i, *site(u), (rule_of(u, RULES) or [None])[-1]) if u and "://" in u else (i, "", "", None) for i, u, _ in PAGES if i)
    have = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got.collect() if r["page_id"]), key=repr)
    assert have == sorted(want, key=repr)


def test_url_filter_of_nothing(spark, pages):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert redirects.url_verdicts(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in redirects.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


def test_rules_and_redirects_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.b.c", "b.c", "c", "x.c", "y.b.c", "d"]
    rules = [(rng.choice(hosts[:4]).upper(), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(25)]
    urls = [f"http://{rng.choice(hosts)}/{''.join(rng.choices('ab/', k=rng.randint(0, 5)))}" for _ in range(300)]
    moves = [(rng.choice(urls), rng.choice(urls)) for _ in range(60)] + [(None, urls[0]), (urls[0], "nowhere")]
    lowered = [(h.translate(LOWER), p, v) for h, p, v in rules]
    label = {u: u for u in urls}
    for a, b in moves * len(moves):
        if a in label and b in label:
            label[a] = label[b] = min(label[a], label[b])
    for _ in range(len(urls)):
        for a, b in moves:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    best = {u: rule_of(u, lowered) for u in urls}
    bad = {label[u] for u in urls if best[u] and not best[u][1]}
    want = sorted(
        (i, best[u][3] if best[u] else None, ("allow" if best[u][1] else "block") if best[u] else "block" if label[u] in bad else "allow")
        for i, u in enumerate(urls)
    )
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = redirects.url_verdicts(
        pages, spark.createDataFrame(rules, "host string, path string, verdict string"),
        spark.createDataFrame(moves, "source string, target string"),
    )
    assert sorted(tuple(r) for r in got.select("page_id", "rule", "verdict").collect()) == want


# Merkle manifests


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def up(levels, at, node):
    siblings = ""
    for nodes in levels[:-1]:
        low = at // 8 * 8
        run = nodes[low : low + 8]
        siblings += "".join(run[: at - low] + run[at - low + 1 :])
        node = digest("".join(run[: at - low] + [node] + run[at - low + 1 :]))
        at //= 8
    return node, siblings


def manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) as the contract reads."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for k in order:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    levels = {k: climb([leaf_of(r) for r in trees[k]]) for k in order}
    top = climb([levels[k][-1][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for i, r in enumerate(trees[k]):
            other = r
            if r[4] is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0:
                other = (*r[:4], r[4].translate(LOWER))
            node, siblings = up(levels[k], i, leaf_of(other))
            node, more = up(top, at, node)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), levels[k][-1][0], root, digest(siblings + more), node, node == root))
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"
REPORT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [
        (rng.randint(-5, 10**6), rng.choice(["s", None, "ü"]), rng.choice(langs), rng.choice([None, 3]), rng.choice([None, "", "Ab c", "low", "É A", "-", "1:x"]) )
        for _ in range(n)
    ]
    return rows + rows[: n // 10] + [(None, "s", "en", 1, "NULL id"), (None, "s", "en", 1, "NULL id"), (2**62 + 1, None, None, None, None)]


@pytest.mark.parametrize("langs", [["en"], ["en", "de", None, "", "Zz", "日"], [f"l{i}" for i in range(30)]])
def test_manifest(spark, langs):
    rows = documents(400, langs)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{MANIFEST}, tree string, place long").repartition(5)
    got = merkle.tamper_report(df)
    assert sorted(map(repr, map(tuple, got.select(*REPORT).collect()))) == sorted(map(repr, manifest(rows)))


def test_manifest_against_sql(spark, tmp_path):
    df = spark.createDataFrame(documents(120, ["en", None, "fr"]), MANIFEST)
    against_sql(spark, tmp_path, "documents", df, op12_merkle_manifest, OP12)


def test_manifest_over_several_passes(spark):
    rows = [(i, "s", "en" if i % 9 else "de", 1, f"Text {i}") for i in range(merkle.CHUNK * 3)] + [(5, "hot", "en", 1, "same")] * merkle.CHUNK
    got = merkle.tamper_report(spark.createDataFrame(rows, MANIFEST).repartition(7))
    assert sorted(map(repr, map(tuple, got.select(*REPORT).collect()))) == sorted(map(repr, manifest(rows)))


def test_manifest_of_nothing_and_long_texts(spark):
    assert merkle.tamper_report(spark.createDataFrame([], MANIFEST)).count() == 0
    rows = [(1, None, None, None, "Aé" * 2_000_000)]
    got = merkle.tamper_report(spark.createDataFrame(rows, MANIFEST)).collect()
    assert [tuple(got[0][c] for c in REPORT)] == manifest(rows)


def test_siblings_prove_a_row(spark):
    rows = documents(70, ["en", "fr"])
    for r in merkle.proofs(spark.createDataFrame(rows, MANIFEST), siblings=True).collect():
        node = r["leaf"]
        for step in r["siblings"]:
            node = digest(step["left"] + node + step["right"])
        assert node == r["root"] and r["verified"]


def test_states_take_replacement_and_right_siblings_only():
    parent = merkle.Parent(["a", "b", "c"])
    assert parent.fold(1, "x") == digest("axc") and parent.digest == digest("abc") and parent.right[1] == "c"


# Periodic runs


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x < len(w) - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            start = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            length = x - start + q
            smaller = any(all(w[start + i] == w[start + i + p] for i in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append([start, length, q])
    return sorted(found, key=lambda r: (r[0], r[2]))


def block_of(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return Block(None, np.frombuffer(b"".join(data), np.uint8), offsets)


def periodic_words(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 10, 40, 100, 200]), rng.choice([1, 2, 3, 10])
    w = []
    while len(w) < n:
        if rng.random() < 0.6:
            unit = [rng.choice("abcdefghij"[:k]) for _ in range(rng.randint(1, 12))]
            w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        else:
            w += [rng.choice("abcdefghij"[:k]) for _ in range(rng.randint(1, 8))]
    return w[:n]


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(80):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 8))]
        texts += texts[:3]  # Copies in a row are not a run.
        assert periods.Texts(block_of([" ".join(w) for w in texts])).runs == [brute_runs(w) for w in texts]


def test_every_period_and_offset_is_found():
    texts, want = [], []
    for q in range(1, 40):
        for offset in (0, 1, q // 2, q + 3):
            unit = [f"u{i}" for i in range(q)]
            length = max(6, 4 * q)
            texts.append([f"x{i}" for i in range(offset)] + (unit * 7)[:length] + ["end"])
            want.append([[offset, length, q]])
            texts.append([f"x{i}" for i in range(offset)] + (unit * 6)[: length - 1] + ["end"])
            want.append([])
    assert periods.Texts(block_of([" ".join(w) for w in texts])).runs == want


def test_convolution_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 64):
        x = rng.integers(0, 3 * 2**30 + 1, (n, 3), dtype=np.uint64)
        root = pow(5, (3 * 2**30) // n, 3 * 2**30 + 1)
        plain = [[sum(int(x[j, c]) * pow(root, j * k, 3 * 2**30 + 1) for j in range(n)) % (3 * 2**30 + 1) for c in range(3)] for k in range(n)]
        assert periods.transform(x).tolist() == plain


@pytest.mark.parametrize(
    ("text", "count"),
    [
        (["a"] * 100_000, 1), ((["a"] * 9_999 + ["b"]) * 10, 11), (["a", "b"] * 60_000, 1),
        ([f"w{i % 25_025}" for i in range(100_100)], 1), ([f"w{i % 25_026}" for i in range(100_100)], 0),
    ],
)
def test_long_and_heavy_repeats(text, count):
    found = periods.Texts(block_of([" ".join(text)])).runs[0]
    for start, length, period in found:
        assert text[start : start + length - period] == text[start + period : start + length]
        assert start == 0 or text[start - 1] != text[start + period - 1]
        assert start + length == len(text) or text[start + length] != text[start + length - period]
    assert len(found) == count


def expected_digest(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest(),
    )


def test_run_digests(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "\x0b \t"]).join(periodic_words(rng)) + rng.choice(["", " Ä ß", "  "])) for i in range(250)]
    rows += [(None, "a b c d e f g h i j k l"), (7, None), (8, ""), (9, " \n"), (9, " \n"), (-3, "x\u00a0y " * 9), (10, "A a " * 50)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, runs string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(repr(expected_digest(*r)) for r in rows)
    assert periods.run_digests(df.limit(0)).count() == 0


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "so  na na na na na na hey"), (2, "go on go on go on go on go"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periods.periodic_runs(df).collect()}
    assert got[1]["collapsed"] == "so na hey" and got[2]["collapsed"] == "go on" and got[3]["collapsed"] == ""
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 9, 2)] and got[2]["exponent_milli"] == 4500 and got[1]["start"] == 1


def test_text_above_a_block(spark):
    words = [f"w{i % 3000}" for i in range(250_000)]
    row = periods.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 250_000, 3000)] and row["collapsed"] == " ".join(words[:3000])
