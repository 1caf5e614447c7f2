"""Near-duplicate classes and the pipeline against brute force."""

import itertools
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codelake.functions.storage import Stored
from codelake.llm import components, contamination, near

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string"


def labelled(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    seen, out = {}, []
    for r in runs:
        seen[r] = seen.get(r, 0) + 1
        out.append((r, seen[r]))
    return out


def aligned(a, b):
    place = {v: i for i, v in enumerate(a)}
    return near.increasing(np.array([place[v] for v in b if v in place]))


def classes(rows):
    """Least id of the class of each row, by comparing all pairs."""
    texts = sorted({t or "" for _, t in rows})
    sets = [labelled(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 0.8 * max(len(a), len(b)) <= min(len(a), len(b)):
            n = aligned(a, b)
            if n / (len(a) + len(b) - n) >= 0.8:
                top[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        k = group[t or ""]
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [(i, least.get(group[t or ""])) for i, t in rows]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[int(rng.integers(0, len(words)))] = f"new{rng.integers(0, 10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(900)]
    out = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "one two"), (6, "One, two!"), (6, "One, two!"), (None, "one two three")]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(40, 260)))) for _ in range(60)]
    for base in texts[:12]:  # copies of copies, near the threshold and beyond
        chain = base.split(" ")
        for _ in range(6):
            chain = edited(rng, chain, int(rng.integers(1, 4))).split(" ")
            texts.append(" ".join(chain))
        texts += [edited(rng, base.split(" "), int(rng.integers(1, 6))) for _ in range(8)]
        texts += [base, base.upper(), " ".join(base.split(" ")[: int(len(base.split(" ")) * 0.85)])]
    texts += ["und " * 400, "und " * 440, "und " * 900]
    return out + [(100 + i, t) for i, t in enumerate(texts)]


def test_classes(spark, rows):
    table = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("x")).repartition(5)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(table).collect()), key=repr)
    want = sorted(classes(rows), key=repr)
    differ = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert len(differ) <= 1  # a sketch may miss a pair at the threshold
    kept = near.kept_rows(table)
    assert kept.columns == table.columns
    assert kept.count() == len({c for _, c in got})


def test_many_leaders(spark, rows, monkeypatch):
    """Groups that need several rounds, and chunks, give the same classes."""
    table = spark.createDataFrame(rows, DOCS)
    want = sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(table).collect()), key=repr)
    monkeypatch.setattr(near, "LEADERS", 2)
    monkeypatch.setattr(near, "MOST_LEADERS", 4)
    monkeypatch.setattr(near, "CHUNK", 3)
    assert sorted(((r["doc_id"], r["class_id"]) for r in near.near_classes(table).collect()), key=repr) == want


def test_no_rows(spark):
    table = spark.createDataFrame([], DOCS)
    assert near.near_classes(table).count() == 0
    assert near.kept_rows(table).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Stored(spark)).collect()
    assert {(r["node"], r["label"]) for r in got} == {(x, find(x)) for x in list(top)}


def test_labelled_shingles_match():
    from codelake.llm.text import Block

    texts = ["a b c d e f a b c d e f a b c d e", "", "x y", "a b c d e f"]
    data = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    value, counts = near.shingles(Block(None, np.frombuffer(data, np.uint8), offsets))
    want = [labelled(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(value.tolist())) == len(set(flat))
    assert len(set(zip(value.tolist(), flat, strict=True))) == len(set(flat))


def test_pipeline(spark, tmp_path):
    """Each stage on the output of the one before, on a table with planted cases."""
    source = "/root/testdata/sf0.001"
    for name in ("benchmark", "labels"):
        shutil.copy(f"{source}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{source}/benchmark.parquet").limit(3).collect()]
    clean = docs.where("doc_id = 77").first()["text"]
    planted = spark.createDataFrame(
        [(9001, None), (9002, "123 456 ..."), (9003, items[0]), (9004, clean), (9005, clean + " the end"), (9005, clean + " the end")], DOCS
    )
    docs = docs.unionByName(planted, allowMissingColumns=True)
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        path = str(tmp_path / name)
        after.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert kept.exceptAll(before).isEmpty()
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {9001, 9002} and 77 in ids
        if name == "near_dedup":
            assert not ids & {9004, 9005} and 77 in ids
            assert sorted(ids) == sorted(set(c for _, c in classes([(r["doc_id"], r["text"]) for r in before.collect()])))
        if name == "decontaminate":
            assert 9003 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == kept.count() and out.where("not parity or not exact").isEmpty()
    none = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_queries_and_sql(spark):
    import __spark_entry__ as entry
    from registry.check import compare, connect

    source = "/root/testdata/sf0.001"
    queries, sql = entry.queries(), entry.oracle_sql()
    assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)] == [1] * 10 and "pipeline" in queries
    for name in ("op2_chat_format", "op5_decontaminate"):
        rows, problem = compare(spark, connect(source), source, queries[name], sql[name])
        assert problem is None and rows


def test_nested_edits_leave_room(spark):
    rng = np.random.default_rng(8)
    leader = rng.integers(1, 2**62, 1000).astype(np.uint64)
    for shared in (880, 901, 920):
        x, y = leader.copy(), None
        x[-250:] = rng.integers(1, 2**62, 250).astype(np.uint64)
        y = x.copy()
        y[: 1000 - shared] = rng.integers(1, 2**62, 1000 - shared).astype(np.uint64)
        linked = near.Leader(x).compare(y)[0] >= near.SIMILARITY
        rows = []
        for name, text in ((b"x", x), (b"y", y)):
            similarity, differences = near.Leader(leader).compare(text)
            rows.append((b"leader", name, len(text), similarity, near.signed(differences).tolist()))
        room = {bytes(r["node"]): r["room"] for r in near._room(spark.createDataFrame(rows, near._COMPARED)).collect()}
        assert not linked or room[b"x"] + room[b"y"] >= 0
        assert linked == (shared > 888)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that stages use themselves, and one with a dot, come out with their values."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = [base, base, base + " again", "", None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"]
    names = ["_key", "_rows", "_id", "label", "a.b", "key", "row", "own_key", "rows", "n", "bucket", "hash"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{n}` string" for n in names))
    kept = near.kept_rows(docs)
    assert kept.columns == docs.columns
    got = {tuple(r) for r in kept.collect()}
    assert got <= set(rows) and {r[0] for r in got} == {i for i, c in classes([(i, t) for i, t, *_ in rows]) if i == c}
    benchmark = spark.createDataFrame([(1, texts[5])], "item_id long, text string")
    clean = contamination.clean_rows(docs, benchmark)
    assert clean.columns == docs.columns and {tuple(r) for r in clean.collect()} == {r for r in rows if r[0] != 5}


def test_large_group_in_small_chunks(spark, monkeypatch):
    """Leaders and texts in chunks of few bytes, ranked in salted rounds, give the same classes."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    core = list(rng.choice(words, 60))
    rows = []
    for i in range(260):
        w = list(core)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            w[at] = f"x{rng.integers(0, 60)}"
        rows.append((i, " ".join(w)))
    for name, value in (("LEADERS", 8), ("MOST_LEADERS", 16), ("CHUNK", 20), ("CHUNK_BYTES", 2000), ("HOT_ROWS", 5), ("RANKED", 30)):
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr("codelake.functions.skew.fits_broadcast", lambda df: False)
    found = near.near_classes(spark.createDataFrame(rows, DOCS)).select("doc_id", "class_id").collect()
    assert sorted(tuple(r) for r in found) == sorted(classes(rows))
