"""Near-duplicate classes by Order MinHash (operator 2).

A document's items are its word ``SHINGLE``-grams, each labelled with its
occurrence number. Each of ``SKETCHES`` hash functions takes the ``DEPTH`` smallest
items and keeps them in text order; documents whose ordered items agree share a
bucket. Two documents are linked if a banded alignment of their labelled shingle
sequences matches m items with m / (n1 + n2 - m) >= ``SIMILARITY``; the band follows
from that bound, so it loses no such alignment. Classes are connected components.

Scale: equal texts fall together first and only their smallest doc_id goes on. No
bucket is expanded to all its pairs: its members are compared with its first
text, those that fail with the next one left, and so on for ``ROUNDS`` rounds; the
buckets of one group share their leaders, so few pairs are different. Buckets whose
members then still stand in different components are dealt into cells of at most about
2 * ``CELL`` members or 2 * ``CELL_ITEMS`` items; each cell counts shared items by an index and aligns the pairs
across components whose count allows the similarity, until they are joined. So no task
holds a whole large bucket, and only links leave it. Small tables of keys are broadcast after
a count of their bytes, else Spark joins and can split; only texts that share a bucket move.

Words are runs of characters other than ASCII white space, in lower case for
A-Z. A text of fewer than SHINGLE words is one item; a text without words equals
only texts that are the same. Null text counts as empty; null doc_ids sort before
all others; different texts of one doc_id, or of none, are documents of their own,
told apart by their digests; an empty table gives no rows; other columns are
ignored. A pair of similarity s shares a bucket with probability about
1 - (1 - s ** 3) ** 16, 0.99998 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import dropped, groups, sized, small, squeezed, tidy, unsqueezed, written
from .substring import NO_ID, keyed, pieces

U64 = np.uint64
SHINGLE, SIMILARITY, SKETCHES, DEPTH, ROUNDS = 5, 0.8, 16, 3, 3
CELL, CELL_ITEMS = 200, 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOP = U64(2**64 - 1)


def items(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all documents, and each document's first item (n + 1 values)."""
    data = _LOWER[data]
    starts, ends, first = S.words(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    h = S.word_hashes(data, starts, ends)
    n_words = np.diff(first)
    n_items = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    place = np.concatenate([[0], np.cumsum(n_items)])
    owner = np.repeat(np.arange(len(n_items)), n_items)
    at = first[:-1][owner] + np.arange(place[-1]) - place[:-1][owner]
    padded = np.concatenate([h, np.zeros(k, U64)])
    out = np.zeros(len(at), U64)
    left = first[1:][owner] - at
    for j in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + np.where(j < left, padded[at + j], U64(j))
    out = S.mix(out)
    within = S.mix(out ^ S.mix(owner.astype(U64) + U64(1)))
    order, begin = groups(within)
    counts = np.diff(np.append(begin, len(order)))
    label = np.empty(len(order), U64)
    label[order] = (np.arange(len(order)) - np.repeat(begin, counts)).astype(U64)
    return S.mix(out + label * U64(0xD6E8FEB86659FD93)), place


def sketches(item: np.ndarray, place: np.ndarray, m: int = SKETCHES, depth: int = DEPTH) -> np.ndarray:
    """(documents, m) bucket keys; documents without items have zeros."""
    n = len(place) - 1
    out = np.zeros((n, m), U64)
    some = np.flatnonzero(np.diff(place))
    if not len(some):
        return out
    begin, sizes = place[:-1][some], np.diff(place)[some]
    for f in range(m):
        seed, factor = S.mix(np.array([f + 1, f + 7919], U64))
        h = (item ^ seed) * (factor | U64(1))
        chosen = np.full((len(some), depth), len(item), np.int64)
        for d in range(depth):
            low = np.minimum.reduceat(h, begin)
            at = np.flatnonzero((h == np.repeat(low, sizes)) & (h != _TOP))
            owner = np.searchsorted(begin, at, "right") - 1
            chosen[owner, d] = at
            h[at] = _TOP
        chosen.sort(axis=1)
        padded = np.append(item, U64(0))
        key = np.full(len(some), seed, U64)
        for d in range(depth):
            key = S.mix(key * U64(31) + padded[chosen[:, d]])
        out[some, f] = key
    return out


def signed(rows: DataFrame) -> DataFrame:
    """(doc, digest, n, keys) of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, doc, data, offsets in pieces(batches):
            item, place = items(data, offsets)
            keys = sketches(item, place)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), SKETCHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(doc), part.column("digest"), pa.array(np.diff(place)), lists], names=["doc", "digest", "n", "keys"])

    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).mapInArrow(tidy(sign), "doc long, digest binary, n long, keys array<long>")


def sequences(rows: DataFrame) -> DataFrame:
    """(doc, seq): the upper halves of each row's items, packed, from compressed texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, doc, data, offsets in pieces(unsqueezed(batches)):
            item, place = items(data, offsets)
            half = (item >> U64(32)).astype(np.uint32)
            blobs = [half[a:b].tobytes() for a, b in zip(place[:-1], place[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(blobs, pa.binary())], names=["doc", "seq"])

    return rows.mapInArrow(tidy(pack), "doc long, seq binary")


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Similarity m / (n1 + n2 - m) for the longest common subsequence of m items within the band that the
    threshold leaves; 0 as soon as the threshold is out of reach. Repeated items are labelled, so those of a
    sequence are distinct (but for chance, where the first counts)."""
    total = len(a) + len(b)
    need = int(np.ceil(threshold / (1 + threshold) * total - 1e-9))
    if min(len(a), len(b)) < max(need, 1):
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    near = np.abs(i - j) <= total - 2 * need
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    m = len(j)
    if m > 1 and not (np.diff(j) > 0).all():
        from bisect import bisect_left

        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    return m / (total - m) if m >= need else 0.0


def verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose alignment reaches the threshold."""
    left = seqs.select(F.col("doc").alias("a"), F.col("seq").alias("seq_a"))
    right = seqs.select(F.col("doc").alias("b"), F.col("seq").alias("seq_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("seq_a"), batch.column("seq_b")
            same = [aligned(np.frombuffer(a[i].as_buffer(), np.uint32), np.frombuffer(b[i].as_buffer(), np.uint32)) >= SIMILARITY for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b")
    return joined.mapInArrow(tidy(check), "a long, b long")


def _across(mixed: DataFrame, seqs: DataFrame) -> DataFrame:
    """(a, b): links that join the components (label) met in one bucket (key), for members (rep)."""
    enough = F.greatest(F.count("*") / CELL, F.sum("n") / CELL_ITEMS)
    blocks = written(mixed.groupBy("key").agg(F.ceil(enough).cast("int").alias("blocks")), "blocks", thin=True)
    rows = mixed.join(sized(blocks, 48), "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "label")
    joined = rows.join(seqs.withColumnRenamed("doc", "rep"), "rep")

    def cell(t: pa.Table) -> pa.Table:
        rep, label, block = (t.column(c).to_numpy() for c in ("rep", "label", "block"))
        seq = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("seq")]
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        size = np.array([len(x) for x in seq])
        items = np.concatenate(seq)
        order = np.argsort(items, kind="stable")
        owner, items = np.repeat(np.arange(len(seq)), size)[order], items[order]
        root = {int(x): int(x) for x in label}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i in np.flatnonzero(block == low):
            a, b = np.searchsorted(items, seq[i], "left"), np.searchsorted(items, seq[i], "right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(seq))
            able = shared >= SIMILARITY / (1 + SIMILARITY) * (size[i] + size) - 1e-6
            able &= (np.arange(len(seq)) > i) if low == high else (block == high)
            for j in np.flatnonzero(able):
                x, y = find(int(label[i])), find(int(label[j]))
                if x != y and aligned(seq[i], seq[j]) >= SIMILARITY:
                    root[max(x, y)] = min(x, y)
                    found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        left, right = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return joined.groupBy("key", "low", "high").applyInArrow(cell, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links", thin=True)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.where("u != v").distinct(), "links", thin=True)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        after = written(small.where("u != v").distinct(), "links", thin=True)
        # stars only: no smaller end is a larger end of another link, and nothing moved
        steady = after.select(F.col("v").alias("u")).distinct().join(after.select("u"), "u", "left_semi").isEmpty()
        edges = after
        if steady and after.groupBy("u").count().where("count > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _labelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", column), column, "left").withColumn("label", F.coalesce("label", column))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc, digest, rep, class_id, class_digest, n_links): rep is the smallest doc with the same text; (class_id,
    class_digest) the smallest (doc, digest) of the component."""
    spark = docs.sparkSession
    rows = keyed(docs)
    signs = written(signed(rows), "signs")
    # a node for each different text, numbered when the table is written
    reps = signs.groupBy("digest").agg(F.min("doc").alias("doc"), F.min_by(F.struct("keys", "n"), "doc").alias("s"))
    reps = written(reps.select("digest", "doc", F.monotonically_increasing_id().alias("rep"), "s.*"), "reps")
    spread = reps.where("n > 0").select("rep", "n", F.explode("keys").alias("key"))
    met = written(spread.groupBy("key").count().where("count > 1").select("key"), "keys", thin=True)
    bucketed = written(spread.join(sized(met, 48), "key").dropDuplicates(["key", "rep"]), "buckets", thin=True)
    involved = written(reps.select("digest", "doc", "rep").join(bucketed.select("rep").distinct(), "rep", "left_semi"), "involved", thin=True)
    own = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    if small(involved, 96):  # only involved texts move
        moved = own.join(F.broadcast(involved), ["digest", "doc"]).select(F.col("rep").alias("doc"), "text")
        texts = squeezed(moved).dropDuplicates(["doc"])
    else:
        texts = squeezed(own, "digest").join(involved, ["digest", "doc"]).select(F.col("rep").alias("doc"), "text").dropDuplicates(["doc"])
    seqs = written(sequences(texts), "sequences")

    links, rest, used = None, bucketed, [bucketed]
    for _ in range(ROUNDS):
        order = F.struct(F.col("rep"), F.col("n"))
        leaders = rest.groupBy("key").agg(F.min(order).alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", "lead.rep", "lead.n").toDF("key", "a", "na")
        pairs = rest.join(sized(written(leaders, "leaders", thin=True), 64), "key").where("rep != a").withColumnRenamed("rep", "b")
        close = F.least("n", "na") >= SIMILARITY * F.greatest("n", "na")
        tested = pairs.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = written(verified(tested, seqs), "verified")
        links = found if links is None else written(links.union(found).distinct(), "verified", thin=True)
        ok = sized(found.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).alias("ok")), 64)
        done = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(ok, ["x", "y"], "left")
        rest = written(done.where("ok is null").select("key", F.col("b").alias("rep"), "n"), "buckets", thin=True)
        used.append(rest)
    labels = components(links)
    marked = written(_labelled(bucketed, "rep", labels), "buckets", thin=True)
    split = written(marked.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("key"), "keys", thin=True)
    more = written(_across(marked.join(sized(split, 48), "key").select("key", "rep", "n", "label"), seqs), "verified")
    if not more.isEmpty():
        labels = components(links.union(more).union(labels.toDF("a", "b")))
    links = links.union(more).distinct()
    n_links = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    own = reps.select("digest", "doc", "rep")
    members = labels.union(labels.select("label", "label").distinct()).toDF("rep", "label").join(own, "rep")
    lead = members.groupBy("label").agg(F.min(F.struct("doc", "digest")).alias("lead"))
    per_rep = own.join(members.join(lead, "label").select("rep", "lead"), "rep", "left").join(n_links, "rep", "left")
    per_rep = per_rep.select("digest", F.col("doc").alias("rep"), F.coalesce("lead", F.struct("doc", "digest")).alias("lead"), "n_links")
    out = signs.select("doc", "digest").join(per_rep, "digest")
    out = out.select("doc", "digest", "rep", F.col("lead.doc").alias("class_id"), F.col("lead.digest").alias("class_digest"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # the result is a small table of its own; the working tables go
    out = written(out, "classes")
    dropped(spark, [signs, reps, seqs, marked, more, *used])
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that lead their class, all columns as they are. Of rows with one doc_id and one text that lead,
    the one of the smallest digest of all its columns stays."""
    classes = near_duplicates(docs)
    leads = F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    others = written(classes.where(~leads).select("doc", "digest").distinct(), "others", thin=True)
    repeated = written(classes.where(leads).groupBy("doc", "digest").count().where("count > 1").select("doc", "digest"), "repeated", thin=True)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("digest"))
    out = own.join(sized(others, 64), ["doc", "digest"], "left_anti")
    if not repeated.isEmpty():
        again = out.join(repeated, ["doc", "digest"], "left_semi").groupBy("doc", "digest").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
        out = out.join(repeated, ["doc", "digest"], "left_anti").select("row").unionAll(again.select("row"))
    return out.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: each document's class (its smallest doc_id and that text's digest), the representative of its exact text and
    the verified links of that text."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    null = lambda c: F.expr(f"nullif({c}, {NO_ID})").alias
    return out.select(null("doc")("doc_id"), null("class_id")("class_id"), F.lower(F.hex("class_digest")).alias("class_digest"), null("rep")("copy_of"), "n_links")
