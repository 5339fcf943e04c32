"""Lexical and vector retrieval, chunking, result lists for rankers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def bm25(docs: DataFrame, queries: DataFrame, group: str, key: str, text: str, terms: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, most_tokens: int = 5000, most_groups: int = 100_000) -> DataFrame:
    """Okapi scores of a group's documents for the group's query terms (an array column of ``queries``).

    Only counts of query terms are shuffled: a document's terms are counted in its row. Negative idf becomes
    epsilon times the group's mean idf over all of its terms, so document frequencies of all terms are aggregated.
    """
    tokens = F.slice(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), " "), 1, most_tokens)
    rows = docs.select(group, key, tokens.alias("__t"))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__docs"), F.avg(F.size("__t")).alias("__avg"))
    df = rows.select(group, key, F.explode(F.array_distinct("__t")).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("__df"))
    idf = df.join(size, group).withColumn("__idf", F.log(F.col("__docs") - F.col("__df") + 0.5) - F.log(F.col("__df") + 0.5))
    mean = idf.groupBy(group).agg(F.avg("__idf").alias("__mean"))
    wanted = queries.select(group, F.explode(F.array_distinct(terms)).alias("term"))
    weight = idf.join(wanted, [group, "term"]).join(mean, group).select(group, "term", F.when(F.col("__idf") < 0, epsilon * F.col("__mean")).otherwise(F.col("__idf")).alias("__w"))
    weights = weight.groupBy(group).agg(F.collect_list(F.struct("term", "__w")).alias("__ws")).join(size, group)
    # one row a group: broadcast after a count, so that token lists stay where they are
    if queries.select(group).distinct().limit(most_groups + 1).count() <= most_groups:
        weights = F.broadcast(weights)
    scored = rows.join(weights, group, "left")
    scored = scored.withColumn("__hits", F.filter("__t", lambda x: F.exists("__ws", lambda w: w["term"] == x)))
    tf = lambda t: F.size(F.filter("__hits", lambda x: x == t)).cast("double")
    part = lambda w: w["__w"] * tf(w["term"]) * (k1 + 1) / (tf(w["term"]) + k1 * (1 - b + b * F.size("__t") / F.col("__avg")))
    total = F.aggregate(F.coalesce("__ws", F.array().cast("array<struct<term:string,__w:double>>")), F.lit(0.0), lambda s, w: s + part(w))
    return scored.select(group, key, total.alias("bm25"))


def retrieve(queries: DataFrame, chunks: DataFrame, keys: list[str], vector: str, chunk_vector: str, text: str, order: str, k: int = 3, separator: str = " --- ", block: int = 8192, most_groups: int = 100_000) -> DataFrame:
    """For each query the joined texts of its k most similar chunks under the same keys; empty where there are none.

    The queries and the chunks of a key are dealt into blocks of about ``block`` rows. Each pair of blocks is compared by
    one matrix product, of which only the k best chunks of each query leave the task; scores, and places of equal ones by
    ``order``, are those of ``cosine`` row by row.
    """
    ids = [c for c in queries.columns if c != vector]
    other = chunks.select(*keys, F.col(chunk_vector).alias("__v"), F.col(text).alias("__text"), F.col(order).alias("__order"))
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    sizes = blocks(queries, "__nq").join(blocks(other, "__nc"), keys)
    # one row a key: broadcast after a count, so that vectors are shuffled once
    if sizes.limit(most_groups + 1).count() <= most_groups:
        sizes = F.broadcast(sizes)
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = queries.join(sizes, keys).withColumn("__a", dealt(queries, "__nq")).withColumn("__b", every("__nc")).select(*queries.columns, "__a", "__b")
    held = other.join(sizes, keys).withColumn("__b", dealt(other, "__nc")).withColumn("__a", every("__nq"))
    held = held.select(*[F.col(c).alias(f"__of_{c}") for c in keys], "__v", "__text", "__order", "__a", "__b")  # names of its own, as both sides may come of one table
    fields = [*(queries.schema[c] for c in ids), StructField("__s", DoubleType()), other.schema["__text"], other.schema["__order"]]
    of = held.groupBy(*[f"__of_{c}" for c in keys], "__a", "__b")
    scored = asked.groupBy(*keys, "__a", "__b").cogroup(of).applyInArrow(_block_best(ids, vector, k), StructType(fields))
    w = Window.partitionBy(*ids).orderBy(F.desc("__s"), "__order")
    top = scored.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    joined = top.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("__n", "__text"))).alias("__l")).select(*ids, F.array_join(F.transform("__l", lambda x: x["__text"]), separator).alias("passage"))
    return queries.select(*ids).join(joined, ids, "left").withColumn("passage", F.coalesce("passage", F.lit("")))


def _block_best(ids: list[str], vector: str, k: int):
    """A map function from a block of queries and one of chunks to each query's k best chunks."""

    def best(left, right):
        import pyarrow.compute as pc

        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, sort_keys=[("__order", "ascending")], null_placement="at_start"))
            which, item, score = _closest(left.column(vector), right.column("__v"), k)
        else:
            which, item, score = [[], [], []]
        return _rows(left.select(ids), right.select(["__text", "__order"]), which, item, score)

    return best


def _rows(left, right, which, item, score):
    import pyarrow as pa

    a, b = left.take(pa.array(which, pa.int64())), right.take(pa.array(item, pa.int64()))
    return pa.table([*a.columns, pa.array(score, pa.float64()), *b.columns], names=[*a.column_names, "__s", *b.column_names])


def _by_length(lists) -> dict:
    """Rows and matrix of an Arrow column's vectors of each length; empty ones and those with a null have no score but 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    a = pa.concat_arrays(lists.chunks)
    sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(a)
    if flat.null_count:
        sizes[pc.list_parent_indices(a).to_numpy(zero_copy_only=False)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = 0
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        out[n] = rows, pc.cast(pc.list_flatten(a.take(pa.array(rows))), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _closest(queries, items, k: int, cells: int = 1 << 22):
    """Places of queries, places of their k nearest items and cosines, ties by the items' places, as ``cosine`` counts them.

    A matrix product, whose sums have another order, only screens: what it puts within 1e-9 of the k-th best, and all
    vectors of extreme length, is summed again entry by entry. Of equal vectors the first k are enough.
    """
    import numpy as np
    import pandas as pd

    def norm(m):
        total = np.zeros(len(m))
        for i in range(m.shape[1]):
            total += m[:, i] * m[:, i]
        return np.sqrt(total)

    asked, held = _by_length(queries), _by_length(items)
    rest = np.setdiff1d(np.arange(len(queries)), np.concatenate([np.empty(0, np.int64), *(rows for rows, _ in asked.values())]))
    found = [(np.repeat(rest, min(k, len(items))), np.tile(np.arange(min(k, len(items))), len(rest)), np.zeros(len(rest) * min(k, len(items))))]
    for n, (rows, q) in asked.items():
        at, x = held.get(n, (np.empty(0, np.int64), np.empty((0, n))))
        other = np.setdiff1d(np.arange(len(items)), at)[:k]  # their cosine is 0
        copy = pd.Series([v.tobytes() for v in x], dtype=object)
        first = copy.groupby(copy).cumcount().to_numpy() < k
        at, x = at[first], x[first]
        nq, nx = norm(q), norm(x)
        plain = lambda m: (m > 1e-100) & (m < 1e100)
        known = np.flatnonzero(plain(nx))
        step = max(1, cells // max(1, len(x)))
        for lo in range(0, len(q), step):
            part = slice(lo, lo + step)
            near = np.ones((len(q[part]), len(x)), bool)
            if len(known) > k:
                s = (q[part] @ x[known].T) / (nq[part, None] * nx[known])
                near[:, known] = s >= np.partition(s, len(known) - k, axis=1)[:, len(known) - k, None] - 1e-9
                near[~plain(nq[part])] = True
            i, j = np.nonzero(near)
            dot = np.zeros(len(i))
            for d in range(n):
                dot += q[part][i, d] * x[j, d]
            size = nq[part][i] * nx[j]
            score = np.where(size == 0, 0.0, dot / np.where(size == 0, 1.0, size))
            m = len(q[part])
            i, j, score = np.concatenate([i, np.repeat(np.arange(m), len(other))]), np.concatenate([at[j], np.tile(other, m)]), np.concatenate([score, np.zeros(m * len(other))])
            by = np.lexsort((j, np.where(np.isnan(score), -np.inf, -score), i))
            i, j, score = i[by], j[by], score[by]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((rows[part][i[top]], j[top], score[top]))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def nearest(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """The k most similar items of each query, exact, with the queries in blocks.

    A block of about ``block`` queries goes to the executors; every partition keeps its k best of each, and the final
    choice sees those alone, so no table of pairs is ever shuffled. The block bounds what the driver holds.
    """
    import numpy as np

    blocks = max(1, -(-queries.count() // block))
    dealt = queries.select(F.col(key).cast("long").alias("__k"), F.col(vector).alias("__q"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("__block"))
    found = None
    for n in range(blocks):
        part = dealt.where(F.col("__block") == n).orderBy("__k").select("__k", "__q").toArrow()
        if not part.num_rows:
            continue
        ids = part.column(0).to_pylist()
        q = np.array(part.column(1).to_pylist(), np.float64)
        near = items.select(F.col(key).cast("long"), vector).mapInArrow(_best(ids, q, k), "query long, item long, similarity double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query long, item long, similarity double, place int")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _best(ids: list, queries, k: int):
    """A map function from items to the k best of each batch for each query."""
    import numpy as np

    q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
            take = np.argsort(-s, axis=1, kind="stable")[:, : min(k, s.shape[1])]
            keys = np.array(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take.shape[1])), pa.array(keys[take.ravel()]), pa.array(np.take_along_axis(s, take, 1).ravel())], names=["query", "item", "similarity"])

    return best


def chunk_text(text: str | None, size: int = 800, overlap: int = 200, least: int = 100) -> list[str]:
    """Paragraphs, else sentences, else words, packed up to ``size`` characters; the next chunk starts with the
    last ``overlap`` characters of the one before (so it may be longer than size); a short last chunk goes."""
    text = (text or "").strip()
    if not text:
        return []

    def pieces(t: str, level: int = 0) -> Iterator[str]:
        if len(t) <= size:
            if t:
                yield t
        elif level == 0:
            for p in re.split(r"\n\s*\n", t):
                yield from pieces(p.strip(), 1)
        elif level == 1:
            for p in re.split(r"(?<=[.!?])\s+", t):
                yield from pieces(p, 2)
        else:
            held = ""
            for w in t.split():
                while len(w) > size:
                    if held:
                        yield held
                        held = ""
                    yield w[:size]
                    w = w[size:]
                if held and len(held) + 1 + len(w) > size:
                    yield held
                    held = w
                else:
                    held = f"{held} {w}" if held else w
            if held:
                yield held

    chunks, held = [], ""
    for p in pieces(text):
        if held and len(held) + 1 + len(p) > size:
            chunks.append(held)
            carry = held[-overlap:] if overlap else ""
            held = f"{carry} {p}" if carry else p
        else:
            held = f"{held} {p}" if held else p
    if held and (len(held) >= least or not chunks):
        chunks.append(held)
    return chunks


def chunks(docs: DataFrame, key: str, text: str, size: int = 800, overlap: int = 200, least: int = 100) -> DataFrame:
    """(key, chunk_idx, text) of every document, by Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(chunk_text(t, size, overlap, least))]
            ks, ix, cs = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ix, pa.int32()), pa.array(cs, pa.string())], names=[key, "chunk_idx", "text"])

    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, chunk_idx int, text string")


def result_spans(df: DataFrame, keys: list[str], position: str, parts: list[str], separator: str = "\n") -> DataFrame:
    """Each result's rendered line, and its character offsets in the whole prompt of its key."""
    line = F.concat(F.col(position).cast("string"), F.lit(". "), F.concat_ws(" | ", *parts))
    w = Window.partitionBy(*keys).orderBy(position, *parts)
    rows = df.where(F.col(position).isNotNull()).withColumn("line", line)
    end = F.sum(F.char_length("line") + len(separator)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(separator)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("line"))


def fallback_order(df: DataFrame, keys: list[str], item: str, position: str, n: int, skipped: list[str] | None = None) -> DataFrame:
    """The first n different items of each key in order of position, without skipped ones."""
    from .ranks import first_seen_rank

    rows = df if not skipped else df.where(~F.col(item).isin(*skipped))
    return first_seen_rank(rows, keys, item, position).where(F.col("rank") <= n)


def rerank(results: DataFrame, keys: list[str], item: str, position: str, n: int, ranker, variant: str, skipped: list[str]) -> DataFrame:
    """(keys, ranked, used_fallback): a ranker's answer cut to n, or the fallback order where nothing parses.

    ``ranker`` is a function from prompt texts to answers, called on Arrow batches. The skip list holds for the
    variant "biased" only.
    """
    from ..functions.texts import ranked_lines

    ordered = F.array_sort(F.collect_list(F.struct(position, item)))
    prompts = results.where(F.col(position).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[item].cast("string")), "\n").alias("prompt"))
    answer = F.pandas_udf(lambda s: ranker(s), "string")
    answered = prompts.withColumn("ranked", F.slice(ranked_lines(answer("prompt")), 1, n)).drop("prompt")
    spare = fallback_order(results, keys, item, position, n, skipped if variant == "biased" else None)
    spare = spare.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item].cast("string")).alias("spare"))
    out = answered.join(spare, keys, "left")
    none = F.size(F.coalesce("ranked", F.array().cast("array<string>"))) == 0
    return out.select(*keys, F.when(none, F.col("spare")).otherwise(F.col("ranked")).alias("ranked"), none.alias("used_fallback"))


def embed_hashed(text: Column, dimensions: int = 16) -> Column:
    """A stand-in embedding for tests: counts of words by hash, without a model."""
    words = F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda w: w != "")
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(words, lambda w: F.pmod(F.hash(w), F.lit(dimensions)) == i)).cast("float"))


def embedded(df: DataFrame, key: str, text: str, embed, batch: int = 64) -> DataFrame:
    """(key, embedding): a function from a list of texts to vectors, called on up to ``batch`` texts at a time; null is ""."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embed([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")
