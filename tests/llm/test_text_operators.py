"""Operators against brute force on small tables with the awkward cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import chat, contamination, fuzzy, langid, licenses, packing, pieces, ppm, quality
from codelake.llm.spread import remainder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string"

LONG = " ".join(f"w{i % 97} über{i % 13}" for i in range(6000))
AWKWARD = [
    (1, None), (2, ""), (3, "..."), (4, "One."), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"),
    (None, "no id here"), (7, LONG), (8, "日本語 ЁЖ ñandú\x00\x7f"), (9, "cc by cc by\ncc-by ALL rights reserved, reserved"),
    (10, "x" * 5000), (11, "\n\n \t"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    # Other columns bear names that the operators use themselves.
    rows = [(i, t, "en", "s", 1.5, 3) for i, t in AWKWARD]
    return spark.createDataFrame(rows, f"{DOCS}, lang string, label string, score double, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, lang string")


def by_row(rows):
    return sorted(((r["doc_id"], *r[1:]) for r in rows), key=repr)


def test_licenses(docs, empty):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    want = []
    for i, text in AWKWARD:
        w, starts, labels = words(text), [], set()
        for label, p in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    got = licenses.license_report(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert by_row(got) == sorted(want, key=repr)
    assert licenses.license_report(empty).count() == 0


def test_altered_notice(spark):
    text = "Intro. This work is licensed under the GNU Affero General Public License, version 3 or later."
    other = "the general meaning of this public work is licensed nowhere and the version is three"
    rows = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame([(1, text), (2, other)], DOCS)).collect()}
    assert rows[1]["labels"] == "gpl,gpl-3.0" and 0 < rows[1]["score"] <= 1
    assert rows[2]["labels"] == "" and rows[2]["score"] == 0


def test_every_word_of_a_notice_may_differ_but_a_name(spark):
    cases = []
    for label, phrase, names in licenses.NOTICES:
        w = phrase.split()
        fixed = {i for n in names for i in range(len(w)) for j in range(len(n.split())) if w[i - j : i - j + len(n.split())] == n.split() and i >= j}
        for i in range(len(w)):
            cases.append((label, i in fixed, " ".join(["intro", *w[:i], "changed", *w[i + 1 :], "end"])))
        cases.append((label, False, phrase.title()))
    cases.append(("mit", False, "It was released under a MIT license."))
    cases.append(("apache-2.0", False, "Licensed under an Apache License, Version 2.0"))
    rows = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], DOCS)
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_report(rows).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(cases) if (c[0] in got[i]) == c[1]]
    assert not wrong, wrong
    others = ["licensed under cc by sa 4 0", "released under the bsd license", "this work is licensed under the gnu general public license version 2"]
    for text, labels in zip(others, ("cc-by", "", "gpl,gpl-2.0"), strict=True):
        assert licenses.license_report(spark.createDataFrame([(1, text)], DOCS)).first()["labels"] == labels


def contaminated(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(0, len(w) - 12) if len(w) >= 13 else min(1, len(w))):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if item is None else str(item))
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [1 << 30, 0])
def test_contamination(spark, docs, empty, monkeypatch, broadcast):
    monkeypatch.setattr("codelake.llm.spread.BROADCAST_BYTES", broadcast)
    items = [
        (1, "the cat sat"), (2, "mat"), (3, None), (4, ""), (5, LONG[3000:3400]), (5, "ñandú"), (None, "no id"), (7, "the cat SAT"),
        (8, " ".join(f"w{i} über{i % 13}" for i in range(13))),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("place", F.lit(1))
    got = contamination.contamination(docs, benchmark).collect()
    assert by_row(got) == sorted(contaminated(AWKWARD, items), key=repr)
    assert contamination.contamination(empty, benchmark).count() == 0
    none = contamination.contamination(docs, benchmark.limit(0)).collect()
    assert by_row(none) == sorted(contaminated(AWKWARD, []), key=repr)
    kept = contamination.clean_rows(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in contaminated(AWKWARD, items))


def test_every_shared_span_has_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(50):
        values = rng.integers(0, 40, 60).astype(np.uint64)
        rows = np.sort(rng.integers(0, 3, 60))
        picked = set(contamination.winnow(values, rows, 9).tolist())
        for k in range(60 - 8):
            if rows[k] == rows[k + 8]:
                best = max(range(k, k + 9), key=lambda i: (-int(values[i]), i))
                assert best in picked


def test_pieces_round_trip(spark, docs, empty):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(docs, "doc_id", "label").collect()
    texts = Counter((t or "") for _, t in AWKWARD)
    assert Counter(reference.decode(r["ids"]) for r in got) == texts
    assert all(r["parity"] and r["exact"] for r in got)
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted(tuple(reference.encode(t or "")) for _, t in AWKWARD)
    back = pieces.decode(pieces.encode(docs, "doc_id"), "doc_id").collect()
    assert Counter(r["text"] for r in back) == texts
    assert pieces.encode(empty, "doc_id").count() == 0


@pytest.mark.parametrize("text", ["a  b", "  ", " a ", "▁x", "a▁b", "\t\n", "😀 é", "aaaa" * 99, "a\u0000b", "<s> </s> <unk>", "<0x41>"])
def test_piece_parity(text):
    import sentencepiece

    codec = pieces.Codec(open(pieces.MODEL, "rb").read())
    ids, counts, parity = codec.encode([text, "", text])
    expected = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert list(ids) == expected * 2 and counts.tolist() == [len(expected), 0, len(expected)] and parity.all()
    assert codec.decode(ids[: counts[0]]) == text.replace("▁", " ")


def unigram_model():
    """A small unigram model as a protobuf message, written field by field."""
    def field(number, wire, body):
        return bytes([number << 3 | wire]) + body if number < 16 else bytes([(number << 3 | wire) & 127 | 128, number >> 4]) + body

    def block(number, body):
        return field(number, 2, bytes([len(body)]) + body)

    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("ab", -4.0, 1), ("a", -5.0, 1), ("b", -5.0, 1), ("▁a", -4.0, 1)]
    out = b""
    for piece, score, kind in pieces_:
        out += block(1, block(1, piece.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))
    out += block(2, field(3, 0, b"\x01"))
    return out + block(3, field(3, 0, b"\x01") + field(4, 0, b"\x00"))


def test_joined_segments_give_the_same_ids():
    with open(pieces.MODEL, "rb") as file:
        raw = file.read()
    texts = ["", " ", "a  b ", "   x", "▁", "日本語 テ\x00 \n\t😀 é", " " * 9, " ".join(f"w{i}ord" for i in range(3000)), "z" * 5000 + " y"]
    joined, single = pieces.Codec(raw, verify=False), pieces.Codec(raw, verify=False)
    assert joined.joins
    single.joins = False
    for group in (texts, texts[7:], ["new words here", "and more words"]):
        for a, b in zip(joined.encode(group), single.encode(group), strict=True):
            assert a.tolist() == b.tolist()


def test_unigram_model():
    codec = pieces.Codec(unigram_model())
    ids, _, parity = codec.encode(["ab a bab"])
    assert parity.all() and codec.decode(ids) == "ab a bab"


def test_chat(spark):
    odd = "a\\b <\\/s> [\\\\INST] <|turn|>x<|says|> </s></s> <|done|>"
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, 1, "assistant", odd),
        (1, 1, "assistant", "same turn"), (1, None, None, "no turn"), (2, 0, "assistant", ""), (3, 0, "user", LONG), (3, 1, "</s>", odd), (None, 0, "user", "x"),
    ]
    rows += [(4, i, ["user", "assistant"][i % 2], f"m{i}") for i in range(37)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digest(table).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    assert chat.digest(table.limit(0)).count() == 0


def test_reply_trees(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; 9 has a parent that is not there; 7 and 8 form a cycle.
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", "c", 5.0),
        ("t", 5, 3, "user", "d", 0.5), ("t", 6, 5, "assistant", "e", 0.5), ("u", 9, 77, "user", "f", None), ("v", 7, 8, "user", "g", 0.0), ("v", 8, 7, "user", "h", 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree string, message long, parent long, role string, text string, score double")
    best = {r["tree"]: r["formatted"] for r in chat.conversations(chat.paths(messages)).collect()}
    assert best.keys() == {"t", "u"}
    assert [m in best["t"] for m in ("q<", "a<", "c<")] == [True] * 3 and "b<" not in best["t"]
    every = chat.paths(messages, None).orderBy("tree", "branch", "place").collect()
    assert [(r["tree"], r["branch"], r["text"]) for r in every] == [
        ("t", 1, "q"), ("t", 1, "a"), ("t", 1, "c"), ("t", 2, "q"), ("t", 2, "b"), ("t", 2, "d"), ("t", 2, "e"), ("u", 1, "f"),
    ]


def test_packing(docs, empty):
    rows = packing.packed(docs, length=256, buffer=3000).collect()
    assert packing.packed(empty).count() == 0
    codec = pieces.Codec(open(pieces.MODEL, "rb").read(), verify=False)
    ids = packing.matrix([r["ids"] for r in rows], 256)
    places = packing.matrix([r["positions"] for r in rows], 256)
    found = Counter()
    parts = {}
    for k, r in enumerate(rows):
        assert r["ends"][0] == 0 and r["ends"][-1] == r["n_tokens"] <= 256
        for doc, start, size, low, high in zip(r["doc_ids"], r["starts"], r["sizes"], r["ends"], r["ends"][1:], strict=False):
            assert high - low == size and (places[k, low:high] == np.arange(size)).all()
            parts.setdefault((doc, start), []).append(ids[k, low:high])
    for doc, text in AWKWARD:
        want = codec.encode([text or ""])[0].tolist() + [2]
        got = []
        while (doc, len(got)) in parts and len(got) < len(want):
            got += parts[doc, len(got)].pop().tolist()
        assert got == want
        found[doc] += 1
    assert not any(v for v in parts.values())


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        length = int(rng.integers(1, 70))
        sizes = rng.integers(1, length + 1, int(rng.integers(0, 80)))
        placed, rows = packing.best_fit(sizes, length)
        free, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [r for r in range(len(free)) if free[r] >= sizes[i]]
            if not fits:
                free.append(length)
                fits = [len(free) - 1]
            best = min(free[r] for r in fits)
            free[next(r for r in fits if free[r] == best)] -= sizes[i]
            want[i] = best
        assert rows == len(free)
        used = np.bincount(placed, sizes, rows) if rows else np.zeros(0)
        assert (used <= length).all() and sorted(used) == sorted(length - f for f in free)


def test_fuzzy(docs, empty, spark):
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 5] + [(20 + i, f"text number {i} " * (i + 1)) for i in range(40)]
    got = {r["doc_id"]: r for r in fuzzy.neighbours(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (i, text), (j, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == fuzzy.fingerprints([text.encode()])[0] and r["edited_fingerprint"] == fuzzy.fingerprints([new.encode()])[0]
        assert r["near_edited"] == fuzzy.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fuzzy.likeness(r["fingerprint"], got[j]["fingerprint"])
    assert fuzzy.neighbours(docs).count() == len(AWKWARD)
    assert fuzzy.neighbours(empty).count() == 0
    assert fuzzy.neighbours(spark.createDataFrame([(1, "alone " * 50)], DOCS)).count() == 1


def test_short_edited_texts_are_alike():
    rng = np.random.default_rng(11)
    for n in range(12, 61):
        texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for _ in range(41)]
        new = [fuzzy.edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, other = (fuzzy.fingerprints([t.encode() for t in x]) for x in (texts, new))
        assert min(fuzzy.likeness(a, b) for a, b in zip(own, other, strict=False)) > 0
        assert sum(fuzzy.likeness(a, b) > 0 for a, b in zip(own, own[1:], strict=False)) <= 8  # other texts


def test_common_length():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = ("".join(rng.choice(list("abc"), int(rng.integers(0, 15)))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.common_length(a, b) == table[-1][-1]


def ppm_score(train, text):
    """Prediction by partial matching with exclusion, by the book."""
    order, begin, end = ppm.ORDER, bytes([ppm.BEGIN]), ppm.END
    counts = {}
    for t in train:
        body = begin * order + (t or "").encode()
        for k, symbol in enumerate([*(t or "").encode(), end]):
            context = body[: k + order]
            for n in range(order + 1):
                own = context[len(context) - n :]
                counts.setdefault(own, Counter())[symbol] += 1
    total = 0.0
    body = begin * order + (text or "").encode()
    for k, symbol in enumerate([*(text or "").encode(), end]):
        context, excluded = body[: k + order], set()
        for n in range(order, -1, -1):
            own = counts.get(context[len(context) - n :])
            if own is None:
                continue
            left = {s: c for s, c in own.items() if s not in excluded}
            if symbol in left:
                total += math.log10(left[symbol] / (sum(left.values()) + len(left)))
                break
            if left:
                total += math.log10(len(left) / (sum(left.values()) + len(left)))
            excluded |= set(own)
        else:
            total += math.log10(1 / (ppm.SYMBOLS - len(excluded)))
    return total


@pytest.mark.parametrize("broadcast", [1 << 26, 600, 0])
def test_ppm(docs, empty, broadcast):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0
    got = ppm.scores(docs, remainder(F.col("doc_id"), 3) == 0, broadcast).collect()
    token = re.compile(r"[^\x20\x09-\x0D]+")
    split = lambda t: [*token.findall((t or "").translate(LOWER)), None]
    train = [t for i, t in AWKWARD if not held(i)]
    counts = Counter(w for t in train for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in AWKWARD:
        own = split(text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, base, ppm_score(train, text)))
    for a, b in zip(by_row(got), sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)
    assert ppm.scores(empty, F.lit(False)).count() == 0


def test_ppm_shuffles_rare_pairs_only():
    """A table of costs too large to be broadcast whole still spares its frequent pairs the join."""
    import types

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"_rid": [0, 1], "doc_id": [5, 6], "text": ["abab" * 50, "abab" * 50 + "z"], "held_out": [False, False]}
    )
    block = next(iter(ppm.blocks(batch)))
    every, times = np.unique(ppm.pairs(block)[0], return_counts=True)
    known = ppm.Table.__new__(ppm.Table)
    known.keys, known.values = every[times > 10], np.full((times > 10).sum(), -0.5)
    none = ppm.Table.__new__(ppm.Table)
    none.keys, none.values = np.zeros(0, np.uint64), np.zeros(0)
    run = ppm._partial(types.SimpleNamespace(value=known), types.SimpleNamespace(value=none))
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    rare = {r["key"] % (1 << 64) for r in rows if r["kind"] == 2}
    assert rare == set(every[times <= 10].tolist())
    score = {r["_rid"]: r["score"] for r in rows if r["kind"] == 0}
    assert score[0] == -0.5 * times[times > 10].sum() / 2


def test_ppm_any_room(docs):
    """Whatever part of the costs is broadcast, the rows are the same."""
    held = remainder(F.col("doc_id"), 3) == 0
    want = by_row(ppm.scores(docs, held).collect())
    for room in (160, 16 * 200):
        got = by_row(ppm.scores(docs, held, room).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_ppm_without_training(docs):
    got = ppm.scores(docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in got} == {0} and all(r["n_known"] == 0 for r in got)
    assert by_row(got)[0][6] <= math.log10(1 / ppm.SYMBOLS) + 1e-9


def test_language_id(spark, docs, empty):
    samples = {"en": "the quick fox and the lazy dog were there", "de": "der schnelle fuchs und die faulen hunde", "fr": "le renard et les chiens étaient là où"}
    rows = [(i, f"{t} {w}", lang) for lang, t in samples.items() for i, w in enumerate(t.split() * 3)]
    model = langid.train(spark.createDataFrame([*rows, (99, "zzz", None), (98, None, "en")], f"{DOCS}, lang string"))
    assert model.languages == ("de", "en", "fr")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame([(1, "der hund"), (2, "the dog"), (3, None), (4, "12 ½ ..."), (5, "")], DOCS), model, "doc_id").collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and 0 < got[1][1] <= 1
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert langid.predict(docs, model, "doc_id").count() == len(AWKWARD)
    untaught = langid.train(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, untaught, "doc_id").collect()} == {"und"}
    kept = langid.sure_rows(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 8


def test_language_matrix_is_naive_bayes(spark):
    rows = [(1, "aab", "x"), (2, "abb", "x"), (3, "bbb", "y")]
    model = langid.train(spark.createDataFrame(rows, f"{DOCS}, lang string"))
    for i, lang in enumerate(model.languages):
        counts = np.zeros(1 << langid.BITS)
        for _, text, own in rows:
            if own == lang:
                for h in langid.buckets([text])[1]:
                    np.add.at(counts, h[h < 1 << langid.BITS], 1)
        want = np.log((counts + langid.SMOOTHING) / (counts.sum() + langid.SMOOTHING * len(counts)))
        assert np.allclose(model.log_prob[i, :-1], want, atol=1e-5)


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(7)
    good = [(i, " ".join(f"word{j}" for j in rng.integers(0, 400, 60)), 1) for i in range(300)]
    bad = [(i, "BUY!! NOW!! " * 20 + str(i), 0) for i in range(300, 400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, None), (7, 1)], "doc_id long, quality int")
    model = quality.train(table, labels, remainder(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model, "doc_id").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(got[i] >= quality.THRESHOLD) == (i < 300) for i in held]
    assert sum(right) >= 0.95 * len(right)
    scores = quality.score(docs, model, "doc_id").collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scores)
    nothing = quality.train(empty, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs, nothing, "doc_id").collect()} == {0.0, 0.5}
    assert quality.good_rows(docs, nothing, 0.2).columns == docs.columns


def test_repeated_ids_teach_once(docs):
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    learn = F.col("doc_id") >= 0
    once = quality.train(docs, labels, learn)
    often = quality.train(docs.join(docs.sparkSession.range(50).select(F.lit(1).alias("again"))).drop("again"), labels, learn)
    assert len(once.weights) and np.allclose(once.centre, often.centre) and np.allclose(once.weights, often.weights, atol=1e-2)


def test_fit_copies_no_sample():
    import tracemalloc

    rng = np.random.default_rng(3)
    positive, other = (rng.random((n, quality.WIDTH), dtype=np.float32) for n in (2000, 6000))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    model = quality.fit(positive, other, 0.5)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    # One of the two arrays is turned to double precision at a time; nothing else is as large as the sample.
    assert len(model.weights) == quality.WIDTH and peak < 2 * (positive.nbytes + other.nbytes)


def test_the_sample_is_not_fitted_on_the_driver(docs, monkeypatch):
    import os

    width = quality.WIDTH
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def fit(positive, other, prior):
        model = quality.Model(np.full(width, len(positive)), float(os.getpid()), np.full(width, len(other)), np.ones(width))
        assert np.isfinite(positive).all() and np.isfinite(other).all()
        return model

    monkeypatch.setattr(quality, "fit", fit)
    model = quality.train(docs, labels, F.col("doc_id") >= 0)
    # Labelled 1 and with words: 5, 7, 9; with words at all: 4, 5, 7, 8, 9, 10.
    assert model.bias != os.getpid()
    assert set(model.weights) == {3} and set(model.centre) == {6}
    few = quality.train(docs, labels, F.col("doc_id") >= 0, 2, 4)
    assert set(few.weights) <= {0, 1, 2} and set(few.centre) <= {1, 2, 3, 4}


def test_readme_names_the_module_of_every_query():
    from pathlib import Path

    from codelake.llm.registry import QUERIES

    text = (Path(__file__).parents[2] / "codelake" / "llm" / "README.md").read_text()
    table = text.split("| Query | Module | Method |")[1].split("\n\n")[0]
    rows = dict(re.findall(r"^\| `(op\w+)` \| `(\w+)` \|", table, re.M))
    assert set(rows) == set(QUERIES)
    assert all((Path(__file__).parents[2] / "codelake" / "llm" / f"{m}.py").exists() for m in rows.values())


def test_every_root_of_a_tree_has_its_best_path(spark):
    rows = [
        ("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 3, 1, "assistant", "c", 2.0), ("t", 4, 2, "user", "d", 5.0),
        ("t", 10, None, "user", "x", 0.0), ("t", 11, 10, "assistant", "y", 0.5), ("t", 12, 10, "assistant", "z", 0.5), ("t", 20, None, "user", "lone", 9.0),
        ("u", 1, 99, "user", "its parent is absent", 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree string, message long, parent long, role string, text string, score double")
    got = {}
    for r in sorted(chat.paths(messages).collect(), key=lambda r: (r["tree"], r["leaf"], r["place"])):
        got.setdefault((r["tree"], r["leaf"]), []).append(r["text"])
    assert got == {("t", 4): ["a", "b", "d"], ("t", 11): ["x", "y"], ("t", 20): ["lone"], ("u", 1): ["its parent is absent"]}


def test_marks_that_begin_with_letters_and_digits(spark):
    template = chat.Template(open="User: ", between="9|", close="\n_")
    texts = ["User: 9| Us \\User: \n_ User:", "9|U\\ser: ok"]
    rows = spark.createDataFrame([(1, 0, "user", texts[0]), (1, 1, "assistant", texts[1])], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.conversations(chat.paths(chat.chains(rows)), template), template).first()
    assert back["roles"] == ["user", "assistant"] and back["texts"] == texts and back["learned"] == texts[1]
