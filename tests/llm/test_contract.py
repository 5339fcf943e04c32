"""Every registered query on one folder of odd rows, all columns against plain readings of what they hold."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ranklake.llm import html_text, media, packing, queries
from tests.llm.conftest import prose, vocabulary
from tests.llm.test_documents import labelled_shingles

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    words = vocabulary()
    passage = prose(r, words, 70)
    rows = [(i, prose(r, words, r.randint(1, 150))) for i in range(60)]
    rows += [(100 + i, f"{prose(r, words, 5)} {passage} {prose(r, words, 5)}") for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, rows[3][1]), (204, rows[3][1]), (205, "É" * 80), (206, "É" * 80 + "x"), (207, prose(r, words, 9000))]
    rows += [(3, rows[5][1]), (None, passage), (None, rows[7][1]), (208, rows[7][1]), (60, "vile rotten vile rotten words"), (61, "vile " * 30)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    extra = "lang string, source string, n_chars long, n_hit long, spans string, part int, rid long, doc long, score double, label int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, "s", 9, 9, 9, 0.9, 9) for i, t in texts], f"doc_id long, text string, {extra}")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    toxic = {i: int("vile" in (t or "")) for i, t in texts if i is not None and t}
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()] + [(None, 1, 1), (9999, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, texts[60][1]), (2, None), (3, ""), (4, "vile rotten")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    pages = [(1, "http://a.de/x", "<html lang=de><article><h1>Kopf</h1><p>Der und die.</p></article>", "x"), (1, None, None, "y"), (2, "", "", "z"), (None, "http://b.fr", "<p>le et la</p>", "w")]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{root}/pages.parquet")
    return root


def key(x):
    return -(1 << 63) if x is None else x


def rows_of(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def test_near_duplicates(spark, folder, texts):
    got = rows_of(spark, folder, "op2_near_duplicates")
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    different = sorted({t or "" for _, t in texts})
    sets = [labelled_shingles(t) for t in different]
    parent = list(range(len(different)))
    links = [0] * len(different)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= 0.8:
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    ids: dict = {}
    for i, t in texts:
        ids.setdefault(t or "", []).append(key(i))
    lead: dict = {}
    for k, t in enumerate(different):
        own = (min(ids[t]), digest(t))
        lead[find(k)] = min(own, lead.get(find(k), own))
    want = [(key(i), *lead[find(different.index(t or ""))], min(ids[t or ""])) for i, t in texts]
    assert sorted((key(r.doc_id), key(r.class_id), r.class_digest, key(r.copy_of)) for r in got) == sorted(want)
    # links that join a class are all there; within a class not every further one is looked for
    assert all(r.n_links > 0 for r in got if key(r.class_id) != key(r.copy_of)) and all(r.n_links == 0 for r in got if links[[k for k, t in enumerate(different) if min(ids[t]) == key(r.copy_of)][0]] == 0 and key(r.copy_of) not in (key(None), 3, 60))


def test_toxicity(spark, folder, texts, tmp_path):
    got = rows_of(spark, folder, "op3_toxicity")
    assert len(got) == len(texts) and [f for f, _ in queries.queries()["op3_toxicity"](spark, folder).dtypes] == ["doc_id", "held_out", "score", "predicted"]
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # labels of held-out rows change nothing, and score follows the text alone
    from pyspark.sql import functions as F

    import shutil

    other = str(tmp_path / "other")
    shutil.copytree(folder, other)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.mode("overwrite").parquet(f"{other}/labels.parquet")
    assert sorted((key(r.doc_id), r.score) for r in rows_of(spark, other, "op3_toxicity")) == sorted((key(r.doc_id), r.score) for r in got)


def removal(texts, length, cut, joined):
    items = [(key(i), cut(t or "")) for i, t in texts]
    first: dict = {}
    for i, s in items:
        for j in range(len(s) - length + 1):
            k = joined(s[j : j + length])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, s in items:
        drop = np.zeros(len(s), bool)
        for j in range(len(s) - length + 1):
            if first[joined(s[j : j + length])] < i:
                drop[j : j + length] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], drop.astype(int)])) == 1))
        out.append((i, len(s), int(drop.sum()), runs, [x for x, d in zip(s, drop, strict=True) if not d]))
    return out


def test_bytes(spark, folder, texts):
    want = [(i, n, r, s, hashlib.sha256(bytes(k)).hexdigest()) for i, n, r, s, k in removal(texts, 50, lambda t: t.encode(), bytes)]
    got = [(key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, folder, "op6_suffix_array")]
    assert sorted(got) == sorted(want)


def test_words(spark, folder, texts):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    want = [(i, n, r, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, r, _, k in removal(texts, 13, words, tuple)]
    got = [(key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows_of(spark, folder, "op10_substring_dedup")]
    assert sorted(got) == sorted(want)


def test_packing(spark, folder, texts):
    got = rows_of(spark, folder, "op7_packing")
    w = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = [*np.frombuffer(w.whole(t or ""), "<u4").tolist(), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((key(i), k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096
    assert {r.least_sequences for r in got} == {packing.lower_bound(np.array([r.length for r in got]))}
    assert len(places) <= got[0].least_sequences + 1


def test_pages(spark, folder):
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in rows_of(spark, folder, "op8_html_text")))
    node = tuple(np.array(x) for x in html_text.trained())
    assert got == [(0, "http://b.fr", html_text.main_text("<p>le et la</p>", *node), got[0][3]), (1, "", "", 0), (1, "http://a.de/x", "Kopf\nDer und die.", 17), (2, "", "", 0)]
    assert all(n == len(t) for _, _, t, n in got)
    langs = rows_of(spark, folder, "op5_language")
    assert len(langs) == 4 and sorted(r.declared for r in langs) == ["", "", "", "de"] and all(0 < r.posterior <= 1 for r in langs)


def test_media(spark, folder, texts):
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        data = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        stream = media.to_wave(data)
        mel, spans = media.analysed(data)
        tensors = media.patches(mel, spans)
        want.append((key(i), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), media.feature_text(mel, spans), len(tensors), media.tensors_digest(tensors)))
    got = [(key(r.doc_id), *tuple(r)[1:]) for r in rows_of(spark, folder, "op9_media")]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
