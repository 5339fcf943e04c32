"""Word and byte repeats against brute force over all windows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from ranklake.llm import spans, substring, suffix_array
from ranklake.llm.exchange import decode, encode


def brute(items, length, joined):
    """items: (id, sequence) -> (size, removed, runs, kept) for windows that also start in a smaller id."""
    first = {}
    for i, s in items:
        for j in range(len(s) - length + 1):
            k = joined(s[j : j + length])
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, s in items:
        drop = np.zeros(len(s), bool)
        for j in range(len(s) - length + 1):
            if first[joined(s[j : j + length])] < i:
                drop[j : j + length] = True
        out[i] = len(s), int(drop.sum()), len(spans.runs(drop)[0]), [x for x, d in zip(s, drop, strict=True) if not d]
    return out


def test_words(spark, corpus, docs):
    out, paths = substring.remove_repeats(docs)
    got = {r.doc: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    items = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(corpus)]
    want = {i: (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, removed, _, kept) in brute(items, 13, tuple).items()}
    assert got == want
    assert paths.where("length < 1").count() == 0 and paths.count() > 0


def test_bytes(spark, corpus, docs):
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.digests(suffix_array.remove_repeats(docs)).collect()}
    items = [(i, (t or "").encode()) for i, t in enumerate(corpus)]
    want = {i: (n, removed, runs, hashlib.sha256(bytes(kept)).hexdigest()) for i, (n, removed, runs, kept) in brute(items, 50, bytes).items()}
    assert got == want


@pytest.mark.parametrize("module", [substring, suffix_array])
def test_empty_table(empty, module):
    marked = module.remove_repeats(empty)
    assert (marked[0] if isinstance(marked, tuple) else marked).count() == 0


def test_rows_with_one_id_never_cover_each_other(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " more"), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc, r.n_removed) for r in substring.remove_repeats(df)[0].collect())
    # the null id stands before all others and so keeps its words
    assert got == [(substring.NO_ID, 0), (1, 40), (1, 40), (1, 40), (2, 40)]


def test_suffix_order():
    r = np.random.default_rng(1)
    for _ in range(60):
        x = r.integers(97, 97 + r.integers(1, 4), r.integers(1, 300)).astype(np.uint8)
        order = suffix_array.suffix_order(x, 50)
        keys = [x[i : i + 50].tobytes() for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(x)))
        wanted = r.random(len(x)) < 0.3
        order = suffix_array.suffix_order(x, 50, wanted)
        keys = [x[i : i + 50].tobytes() for i in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(wanted).tolist()


def test_winnowing_keeps_equal_places_for_equal_windows():
    r = np.random.default_rng(2)
    h = r.integers(0, 50, 500).astype(np.uint64)
    chosen = set(spans.winnow(h, np.ones(500, bool), 9).tolist())
    for i in range(492):
        assert any(j in chosen and h[j] == h[i : i + 9].min() for j in range(i, i + 9)) or h[i : i + 9].min() == 0


def test_records_round_trip():
    r = np.random.default_rng(4)
    x = np.zeros(100, substring._COVER)
    for c in x.dtype.names:
        x[c] = r.integers(0, 1000, 100)
    assert (decode(np.frombuffer(encode(x), np.uint8), x.dtype) == x).all()
    edges = np.zeros(9, substring._EDGE)
    edges["doc"], edges["pos"] = [1, 1, 1, 1, 2, 2, 2, 2, 2], [0, 1, 2, 7, 0, 1, 2, 3, 4]
    edges["known"] = [0, 0, 0, 0, 2, 2, 0, 0, 2]
    edges["left"] = np.arange(9) * 10
    edges["right"] = np.append(edges["left"][1:], 99)
    edges["right"][[2, 3]] = [5, 6]
    back = substring.decode_edges(np.frombuffer(substring.encode_edges(edges), np.uint8), substring._EDGE)
    assert (back == edges).all()


def test_hot_passage_is_removed_everywhere(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"a{i} {passage} z{i}" if i % 3 == 0 else f"only {i}") for i in range(600)], "doc_id long, text string").repartition(7)
    got = {r.doc: r.n_removed for r in substring.remove_repeats(df)[0].collect()}
    assert all(got[i] == (60 if i % 3 == 0 and i else 0) for i in range(600))


def test_paths_of_chains_and_cycles(spark):
    # runs of one edge each, in documents of their own: chains of 3, 7 and 40 runs, cycles of 2, 3 and 6
    rows, at = [], 0
    for size, ring in ((3, False), (7, False), (40, False), (2, True), (3, True), (6, True)):
        for k in range(size):
            rows.append((at + k, at + (0 if ring and k == size - 1 else k + 1), at + k, 0))
        at += 100
    got: dict = {}
    for r in substring.paths(spark.createDataFrame(rows, "left long, right long, doc long, pos long").selectExpr("*", "0L AS rid")).collect():
        got.setdefault(r.path, set()).add(r.doc)
    assert sorted(sorted(x) for x in got.values()) == [list(range(100 * i, 100 * i + n)) for i, n in enumerate((3, 7, 40, 2, 3, 6))]


def test_spans_with_other_words_than_their_source_are_refuted(spark):
    words = [f"w{i}" for i in range(30)]
    other = [*words[:10], "x", *words[11:]]
    texts = spark.createDataFrame([(1, 1, " ".join(words)), (2, 2, " ".join(words)), (3, 3, " ".join(other))], "doc long, rid long, text string")
    run = "array<struct<pos:long,length:long,sdoc:long,srid:long,spos:long,kind:long{}>>"
    same = (0, 18, 1, 1, 0, 0)
    covered = [(2, 2, [same]), (3, 3, [same])]
    wants = spark.createDataFrame([(1, 1, [(0, 18, -1), (0, 18, 7)])], "doc long, rid long, wants array<struct<pos:long,length:long,path:long>>")

    def check(rows, kind):
        runs = spark.createDataFrame(rows, f"doc long, rid long, runs {run.format(kind)}")
        marked = substring.squeezed(texts, "rid").join(runs, ["doc", "rid"], "left").join(wants, ["doc", "rid"], "left")
        return substring.checked(marked, 13, False).cache()

    out = check(covered, "")
    assert {r.doc: (r.n_removed, r.n_paths) for r in out.where("part is null").collect()} == {1: (0, 1), 2: (30, 0), 3: (30, 0)}
    proofs = out.where("part is not null").select("part", "payload")
    bad = substring.gather(proofs, substring._PROOF, substring.refuted, "sdoc long, srid long, spos long, length long, proof binary").collect()
    assert [(r.sdoc, r.srid, r.spos, r.length, bytes(r.proof)) for r in bad] == [(1, 1, 0, 18, hashlib.md5(" ".join(words).encode()).digest())]
    again = check([(d, r, [(*same, bad[0].proof)]) for d, r, _ in covered], ",proof:binary")
    assert {r.doc: r.n_removed for r in again.where("part is null").collect()} == {1: 0, 2: 30, 3: 0}


def test_stretches_of_one_hash_are_told_apart():
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    x = np.zeros(3, suffix_array._STRETCH)
    x["text"], x["at"], x["length"] = 7, [0, 60, 120], 11
    suffix_array.settle_hashes(x, text)
    assert x["text"][0] == x["text"][2] == 7 != x["text"][1]


def test_rows_without_an_id_are_rows_of_their_own(spark):
    r = np.random.default_rng(6)
    text = [" ".join(f"w{r.integers(0, 10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, x) for x in text] + [(5, x + " more") for x in text] + [(6, text[0]), (6, text[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc, r.n_removed) for r in substring.remove_repeats(df)[0].collect())
    assert got == [(substring.NO_ID, 0)] * 8 + [(5, 60)] * 8 + [(6, 60)] * 2
    size = len(text[0])
    got = sorted((r.doc, r.n_removed) for r in suffix_array.digests(suffix_array.remove_repeats(df)).collect())
    assert [x for x in got if x[0] != 5] == [(suffix_array.NO_ID, 0)] * 8 + [(6, size)] * 2 and all(n >= 300 for d, n in got if d == 5)


@pytest.mark.parametrize("hot", [1, 30])
def test_hot_grams_are_split(spark, corpus, hot):
    """A gram in very many different surroundings: its windows meet by all their bytes or words, and nothing is lost."""
    r = np.random.default_rng(4)
    word = lambda: "w" + str(r.integers(0, 10**7))
    phrase = "all rights of this kind are reserved by us"
    texts = [f"{' '.join(word() for _ in range(9))} {phrase} {' '.join(word() for _ in range(9))}" for _ in range(300)]
    texts += [texts[7] + " tail", "head " + texts[9], texts[11]] + [t for t in corpus if len(t or "") < 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert len(substring.screen(substring.told_apart(substring.keyed(df)), 13, 5, hot)[1]) >= 1
    assert len(suffix_array.screen(substring.told_apart(substring.keyed(df)), hot)[1]) >= (hot == 1)
    got = {x.doc: (x.n_words, x.n_removed) for x in substring.remove_repeats(df, hot=hot)[0].collect()}
    items = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)]
    assert got == {i: v[:2] for i, v in brute(items, 13, tuple).items()}
    got = {x.doc: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_array.digests(suffix_array.remove_repeats(df, hot)).collect()}
    items = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    assert got == {i: v[:3] for i, v in brute(items, 50, bytes).items()}
