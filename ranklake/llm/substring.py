"""Substring removal by compacted de Bruijn graphs (operator 10).

Words are maximal runs of bytes other than ASCII white space, unchanged. An edge
is a window of ``k`` words; its nodes are its first and last ``k - 1`` words. An
edge that starts in two or more documents is repeated, and its source is its
occurrence with the smallest doc_id. A word of a later document goes if a
repeated edge covers it.

Plan:
1. Winnowed fingerprints of short word grams (every window of k words holds one)
   screen places that may repeat. Within a map task equal fingerprints are
   combined first, so a passage in a third of all rows sends one record a flush.
2. Windows whose smallest gram is such a place emit edges, combined in the same way: an
   occurrence that has a smaller one in its own map task is settled and names that
   one as its source. The target partition of an edge's smallest short gram groups the
   others by both 64-bit nodes, and their source is the smallest of the group. Edges
   that follow each other and go to one partition travel as one run of nodes.
3. Nodes with one edge in and one out do not branch. Runs of repeated edges that
   follow each other in their source are joined over such nodes to paths: first
   along the source, then through Spark joins by pointer doubling.
4. Spans, with the coordinates of their sources, go to their documents, and each source
   is asked for its words' digest if its words lie on a path, or in a span of its own
   document that leads to one. A span goes only if the 128-bit digest of its words
   equals its source's; spans refuted so (collisions of hashes) stay.

Rows are known by doc_id and, where a doc_id (or none) has different texts, by a 64-bit
hash of the text, so that they are rows of their own; a hot id is spread by its texts.

Defined cases: a null text has no words; a null doc_id sorts before all others;
rows with one doc_id never cover each other; texts under k words stay whole; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import PACKED, decode, dropped, encode, exchange, gather, groups, packed, partitions, small, squeezed, tidy, unsqueezed, written

U64 = np.uint64
SLICE = 2 << 20
FLUSH = 12 << 20
NO_ID = -(1 << 63)
#: Occurrences from which a fingerprint may outweigh its partition.
HOT = 1 << 18

_FINGER = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("known", "<i4")])
_SPOT = np.dtype([("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4")])
_FROM = [("sdoc", "<i8"), ("srid", "<i8"), ("spos", "<i4")]
#: kind 1: an occurrence in the source's own document, which stays.
_COVER = np.dtype([("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("length", "<i4"), *_FROM, ("kind", "<i4")])
_EDGE = np.dtype([("left", "<u8"), ("right", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("known", "<i4")])
_RUN = np.dtype([("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("length", "<i4"), ("known", "<i4")])
#: What a row is asked as a source (path is -1), or a run of a path that lies in it.
_ASKED = np.dtype([("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("length", "<i4"), ("path", "<i8")])
_PROOF = np.dtype([*_FROM, ("length", "<i4"), ("own", "<i4"), ("high", "<u8"), ("low", "<u8")])


def keyed(docs: DataFrame) -> DataFrame:
    """The operator's own view of a document table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"))


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (doc, text) with rid: a hash of the text where a doc has several different texts, else 0, which costs nothing to
    move. Docs with several are counted before they are broadcast; if they are too many, every row has its hash."""
    hashed = F.xxhash64("text")
    several = rows.groupBy("doc").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low != high").select("doc", F.lit(True).alias("several"))
    several = written(several, "several")
    if not small(several, 64):
        return rows.select("doc", hashed.alias("rid"), "text")
    marked = rows.join(F.broadcast(several), "doc", "left")
    return marked.select("doc", F.when(F.col("several"), hashed).otherwise(F.lit(0).cast("long")).alias("rid"), "text")


def column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in S.slices(batch, "text", most):
            data, offsets = S.text_buffers(part.column("text"))
            yield part, column(part, "doc"), data, offsets


def row_key(records: np.ndarray) -> np.ndarray:
    """Deals rows out by id and text."""
    return S.mix(records["doc"].view(U64) + S.mix(records["rid"].view(U64)))


def flushed(parts: Iterator[np.ndarray], combine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[np.ndarray] = []
    size = 0
    for x in parts:
        held.append(x)
        size += x.nbytes
        if size >= FLUSH:
            yield combine(np.concatenate(held))
            held, size = [], 0
    if held:
        yield combine(np.concatenate(held))


def combine_local(records: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys only the records of the smallest document go to the key's partition. The others are settled
    (known = 1: repeated in a smaller document) and pass through any partition; known = 2 or more says that such exist,
    and in the group's first record, how many more than 2 it is says how many."""
    order, starts = groups(keys)
    records, keys = records[order], keys[order]
    counts = np.diff(np.append(starts, len(records)))
    low = np.repeat(np.minimum.reduceat(records["doc"], starts), counts)
    later = records["doc"] > low
    shared = np.repeat(np.logical_or.reduceat(later, starts), counts)
    records["known"] = np.where(later, 1, np.where(shared, 2, 0))
    least = np.flatnonzero(~later)
    records["known"][least[np.searchsorted(least, starts)]] += np.add.reduceat(later, starts, dtype=np.int32)
    spread = S.mix(np.arange(len(records), dtype=U64) + keys[:1])
    return records, np.where(later, spread, keys)


def shared_spots(records: np.ndarray, n: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Packed places of the fingerprints that start in two or more documents; and with the part -1 those that occur at least
    ``hot`` times and make up an eighth of their partition or more."""
    settled = records["known"] == 1
    keep = [records[settled]]
    if not settled.all():
        open_ = records[~settled]
        order, starts = groups(open_["hash"])
        open_ = open_[order]
        counts = np.diff(np.append(starts, len(open_)))
        shared = np.minimum.reduceat(open_["doc"], starts) < np.maximum.reduceat(open_["doc"], starts)
        keep.append(open_[np.repeat(shared, counts) | (open_["known"] >= 2)])
        often = counts + np.add.reduceat(np.maximum(open_["known"].astype(np.int64) - 2, 0), starts)
        top = np.flatnonzero((often >= hot) & (8 * often >= often.sum()))
        if len(top):
            marks = [open_["hash"][starts[i]].tobytes() for i in top]
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(top), pa.int32()), pa.array(marks, pa.binary())], names=["part", "payload"])
    found = np.concatenate(keep)
    out = np.empty(len(found), _SPOT)
    for c in _SPOT.names:
        out[c] = found[c]
    out = out[np.lexsort((out["pos"], out["rid"], out["doc"]))]
    blobs = packed(out, row_key(out), n)
    if blobs is not None:
        yield blobs


def spots_of(docs: DataFrame, mapper, hot: int) -> tuple[DataFrame, np.ndarray]:
    """(doc, rid, spots) of the shared fingerprints that mapper yields, and the hot ones, at most eight a partition, by
    their upper six bytes."""
    n = partitions(docs.sparkSession)

    def combine(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        records, keys = combine_local(records, records["hash"].copy())
        order = np.lexsort((records["pos"], records["rid"], records["doc"]))
        return records[order], keys[order]

    found = written(exchange(docs, lambda batches, n: flushed(mapper(batches), combine), _FINGER, lambda x: shared_spots(x, n, hot), PACKED), "fingers")
    marks = np.array([int.from_bytes(r["payload"], "little") for r in found.where("part < 0").collect()], U64) >> U64(16)
    spots = written(gather(found.where("part >= 0"), _SPOT, spot_lists, "doc long, rid long, spots array<int>"), "spots")
    dropped(docs.sparkSession, [found])
    return spots, marks


def is_hot(fingers: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin(fingers >> U64(16), hot) if len(hot) else np.zeros(len(fingers), bool)


def screen(docs: DataFrame, window: int, gram: int, hot: int = HOT) -> tuple[DataFrame, np.ndarray]:
    """(doc, rid, spots): word places whose fingerprint starts in two or more documents; and the hot fingerprints."""
    reach = window - gram + 1

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part, doc, data, offsets in pieces(batches):
            starts, ends, first = S.words(data, offsets)
            if len(starts) < window:
                continue
            owner = np.repeat(np.arange(len(doc)), np.diff(first))
            h = S.grams(S.word_hashes(data, starts, ends), gram)
            valid = owner[: len(h)] == owner[gram - 1 :]
            at = S.winnow(h, valid, reach)
            out = np.zeros(len(at), _FINGER)
            out["hash"], out["doc"], out["rid"], out["pos"] = h[at], doc[owner[at]], column(part, "rid")[owner[at]], at - first[owner[at]]
            yield out

    return spots_of(docs, mapper, hot)


def distinct(records: np.ndarray) -> np.ndarray:
    """The different records, in order of their fields."""
    names = records.dtype.names
    records = records[np.lexsort([records[c] for c in reversed(names)])]
    new = np.ones(len(records), bool)
    if len(records):
        new[1:] = np.any([records[c][1:] != records[c][:-1] for c in names], axis=0)
    return records[new]


def row_starts(records: np.ndarray) -> np.ndarray:
    """Where each row's records begin, in records sorted by row."""
    new = np.ones(len(records), bool)
    new[1:] = (records["doc"][1:] != records["doc"][:-1]) | (records["rid"][1:] != records["rid"][:-1])
    return np.flatnonzero(new)


def spot_lists(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document with its places in order."""
    records = distinct(records)
    begin = row_starts(records)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(records)).astype(np.int32)), pa.array(records["pos"].copy()))
    yield pa.RecordBatch.from_arrays([pa.array(records["doc"][begin]), pa.array(records["rid"][begin]), lists], names=["doc", "rid", "spots"])


def own_minimum(spots: pa.ListArray, first: np.ndarray, hashes: np.ndarray, low: np.ndarray, reach: int) -> np.ndarray:
    """Windows (of ``reach`` hashes, minimum ``low``) whose minimum stands at one of the spots, given by document.

    Equal windows have equal minima, so a window whose own minimum is in no other document is in none itself.
    """
    at = spots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at += np.repeat(first[:-1], spots.value_lengths().fill_null(0).to_numpy())
    marked = np.full(len(hashes), 2**64 - 1, U64)
    at = at[at < len(hashes)]
    marked[at] = hashes[at]
    near = S.sliding_min(marked, reach)
    return (near == low) & (low != U64(2**64 - 1))


EDGES = "left long, right long, doc long, rid long, pos long, part int, payload binary"


def edge_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges in order of their nodes and then of (doc, rid, pos), and the start of each group of equal edges."""
    x = x[np.lexsort((x["pos"], x["rid"], x["doc"], x["right"], x["left"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["left"][1:] != x["left"][:-1]) | (x["right"][1:] != x["right"][:-1])
    return x, np.flatnonzero(new)


def sourced(x: np.ndarray, source: np.ndarray, kind: int = 0) -> np.ndarray:
    """Single windows as covers with their sources."""
    out = np.empty(len(x), _COVER)
    for c in ("doc", "rid", "pos"):
        out[c], out[f"s{c}"] = x[c], source[c]
    out["length"], out["kind"] = 1, kind
    return out


def combined_edges(x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal edges of a flush those of the smallest document, with the keys of their partitions; and covers of the
    others, which are settled and whose source is the group's first edge."""
    order = np.lexsort((x["pos"], x["rid"], x["doc"], x["right"], x["left"]))
    x, home = x[order], home[order]
    new = np.ones(len(x), bool)
    new[1:] = (x["left"][1:] != x["left"][:-1]) | (x["right"][1:] != x["right"][:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(x)))
    first = np.repeat(starts, counts)
    later = x["doc"] > x["doc"][first]
    covers = cover_runs(sourced(x[later], x[first[later]]))
    x["known"] = 2 * np.repeat(np.logical_or.reduceat(later, starts), counts)
    x, home = x[~later], home[~later]
    order = np.lexsort((x["pos"], x["rid"], x["doc"]))
    return x[order], S.mix(home[order]), covers


def edges(marked: DataFrame, window: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Repeated edges and covered places. Edges meet by their smallest short gram, or if that is hot, by their nodes.

    Rows with a left node are repeated edges with their source; rows with a part hold packed runs of
    covered windows, for ``gather`` to bring to their documents.
    """
    reach = window - gram + 1
    n = partitions(marked.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, doc, data, offsets in pieces(unsqueezed(batches)):
            starts, ends, first = S.words(data, offsets)
            if len(starts) < window:
                continue
            h = S.word_hashes(data, starts, ends)
            short = S.grams(h, gram)
            home = S.sliding_min(short, reach)
            mask = own_minimum(part.column("spots"), first, short, home, reach)
            words_of = np.repeat(np.arange(len(doc)), np.diff(first))
            mask &= words_of[: len(mask)] == words_of[window - 1 : window - 1 + len(mask)]
            at = np.flatnonzero(mask)
            if not len(at):
                continue
            nodes = S.grams(h, window - 1)
            owner = np.searchsorted(first, at, "right") - 1
            out = np.zeros(len(at), _EDGE)
            out["left"], out["right"] = nodes[at], nodes[at + 1]
            out["doc"], out["pos"], out["rid"] = doc[owner], at - first[owner], column(part, "rid")[owner]
            yield out, np.where(is_hot(home[at], hot), S.mix(nodes[at] * U64(3) + nodes[at + 1]), home[at])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, home = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            x, keys, covers = combined_edges(x, home)
            # settled ones need no partition of their edge: they are dealt out by their rows, whole runs together
            for out in (packed(x, keys, n, lambda r: b"e" + encode_edges(r)), packed(covers, row_key(covers), n, lambda r: b"c" + encode(r))):
                if out is not None:
                    yield out

        for x in parts(batches):
            held.append(x)
            size += x[0].nbytes
            if size >= FLUSH:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, covers = [], []
        for b in batches:
            for x in b.column(1):
                data = np.frombuffer(x.as_buffer(), np.uint8)
                if data[0] == ord("e"):
                    open_.append(decode_edges(data[1:], _EDGE))
                else:
                    covers.append(decode(data[1:], _COVER))
        if open_:
            x = np.concatenate(open_)
            open_.clear()
            x, starts = edge_groups(x)
            counts = np.diff(np.append(starts, len(x)))
            first = np.repeat(starts, counts)
            later = x["doc"] > x["doc"][first]
            covers.append(cover_runs(sourced(x[later], x[first[later]])))
            # occurrences beside the source in its own document, on which settled ones may call
            alike = ~later & (x["known"] == 2)
            alike[starts] = False
            covers.append(sourced(x[alike], x[first[alike]], 1))
            lead = x[starts][np.logical_or.reduceat(later | (x["known"] == 2), starts)]
            del x, first, later, alike
            cols = [lead["left"].copy().view(np.int64), lead["right"].copy().view(np.int64), lead["doc"], lead["rid"], lead["pos"].astype(np.int64)]
            none = [pa.nulls(len(lead), pa.int32()), pa.nulls(len(lead), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *none], names=["left", "right", "doc", "rid", "pos", "part", "payload"])
        if covers:
            runs = cover_runs(np.concatenate(covers))
            moved = packed(runs, row_key(runs), n)
            if moved is not None:
                empty = [pa.nulls(moved.num_rows, pa.int64())] * 5
                yield pa.RecordBatch.from_arrays([*empty, *moved.columns], names=["left", "right", "doc", "rid", "pos", "part", "payload"])

    return marked.mapInArrow(tidy(mapped), PACKED).repartitionById(n, "part").mapInArrow(tidy(reduced), EDGES)


def cover_runs(x: np.ndarray) -> np.ndarray:
    """Covers of one kind joined where both they and their sources go on."""
    x = x[np.lexsort((x["pos"], x["rid"], x["doc"]))]
    new = np.ones(len(x), bool)
    on = np.ones(max(len(x) - 1, 0), bool)
    for c in ("doc", "rid", "sdoc", "srid", "kind"):
        on &= x[c][1:] == x[c][:-1]
    new[1:] = ~(on & (x["pos"][1:] == x["pos"][:-1] + x["length"][:-1]) & (x["spos"][1:] == x["spos"][:-1] + x["length"][:-1]))
    begin = np.flatnonzero(new)
    runs = x[begin]
    if len(begin):
        runs["length"] = np.add.reduceat(x["length"], begin)
    return runs


def encode_edges(x: np.ndarray) -> bytes:
    """Runs of edges (sorted by doc, rid, pos) as a header each and their nodes."""
    new = np.ones(len(x), bool)
    new[1:] = x["pos"][1:] != x["pos"][:-1] + 1
    for c in ("doc", "rid", "known"):
        new[1:] |= x[c][1:] != x[c][:-1]
    begin = np.flatnonzero(new)
    run = np.empty(len(begin), _RUN)
    for c in _RUN.names:
        if c != "length":
            run[c] = x[c][begin]
    run["length"] = np.diff(np.append(begin, len(x)))
    head = encode(run)
    return np.array([len(run), len(head)], np.int64).tobytes() + head + x["left"].tobytes() + x["right"][np.append(begin[1:], len(x)) - 1].tobytes()


def decode_edges(data: np.ndarray, dtype: np.dtype) -> np.ndarray:
    n, size = np.frombuffer(data[:16].tobytes(), np.int64)
    run = decode(data[16 : 16 + size], _RUN)
    length = run["length"].astype(np.int64)
    begin = np.cumsum(length) - length
    out = np.zeros(length.sum(), dtype)
    for c in ("doc", "rid", "known"):
        out[c] = np.repeat(run[c], length)
    out["pos"] = np.repeat(run["pos"] - begin, length) + np.arange(len(out))
    nodes = np.frombuffer(data[16 + size :].tobytes(), np.uint64)
    out["left"] = nodes[: len(out)]
    out["right"][:-1] = out["left"][1:]
    out["right"][begin + length - 1] = nodes[len(out) :]
    return out


def _lists(x: np.ndarray, names: list[str], column: str) -> pa.RecordBatch:
    """One row for each (doc, rid) with a list of the other fields."""
    cut = row_starts(x)
    item = pa.StructArray.from_arrays([pa.array(x[c].astype(np.int64)) for c in names], names=names)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(x)).astype(np.int32)), item)
    return pa.RecordBatch.from_arrays([pa.array(x["doc"][cut]), pa.array(x["rid"][cut]), lists], names=["doc", "rid", column])


def run_lists(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document with its covered runs and their sources."""
    if len(records):
        yield _lists(cover_runs(records), ["pos", "length", "sdoc", "srid", "spos", "kind"], "runs")


RUNS = "doc long, rid long, runs array<struct<pos:long,length:long,sdoc:long,srid:long,spos:long,kind:long>>"


def paths(repeated: DataFrame) -> DataFrame:
    """Compacts repeated edges (left, right, doc, rid, pos) to maximal nonbranching paths.

    Returns one row for each run of a path that lies along one source: path (the number of its first
    run), doc, rid, pos, length. A cycle of nonbranching nodes is cut at its smallest run.
    """
    spark = repeated.sparkSession
    n_out = repeated.groupBy(F.col("left").alias("node")).agg(F.count("*").alias("n_out"))
    n_in = repeated.groupBy(F.col("right").alias("node")).agg(F.count("*").alias("n_in"))
    plain = n_out.join(n_in, "node").where("n_out = 1 and n_in = 1").select("node")

    flagged = repeated.join(plain.select(F.col("node").alias("left"), F.lit(True).alias("inner")), "left", "left")

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables)
        doc, rid, pos, left, right = (t.column(c).to_numpy() for c in ("doc", "rid", "pos", "left", "right"))
        inner = t.column("inner").fill_null(False).to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, rid, doc))
        doc, rid, pos, left, right, inner = doc[order], rid[order], pos[order], left[order], right[order], inner[order]
        goes_on = (doc[1:] == doc[:-1]) & (rid[1:] == rid[:-1]) & (pos[1:] == pos[:-1] + 1) & (left[1:] == right[:-1]) & inner[1:]
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        end = np.append(begin[1:], len(doc)) - 1
        cols = [doc[begin], rid[begin], pos[begin], end - begin + 1, left[begin], right[end], inner[begin]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "rid", "pos", "length", "head", "tail", "inner"])

    n = partitions(spark)
    dealt = flagged.select("doc", "rid", "pos", "left", "right", "inner").repartition(n, "doc", "rid")
    runs_ = dealt.mapInArrow(tidy(along), "doc long, rid long, pos long, length long, head long, tail long, inner boolean")
    runs_ = written(runs_.withColumn("run", F.monotonically_increasing_id()), "runs")
    # a run whose first node does not branch goes on another run, which ends there
    before = runs_.where("inner").select(F.col("head").alias("tail"), F.col("run").alias("after"))
    link = before.join(runs_.select("tail", "run"), "tail").select(F.col("after").alias("run"), F.col("run").alias("root"), F.col("run").alias("low"))
    # open: the first run of the path is not reached yet; on a cycle it never is, and there low is the smallest run seen
    state = runs_.join(link, "run", "left").select("run", F.coalesce("root", "run").alias("root"), F.least("run", F.coalesce("low", "run")).alias("low"), F.col("root").isNotNull().alias("open"))
    last = None
    while True:
        state = written(state, "paths")
        there = state.select(F.col("run").alias("root"), F.col("root").alias("next"), F.col("low").alias("low_next"), F.col("open").alias("open_next"))
        # each round settles some run of every unfinished chain, so an equal count leaves cycles alone, and those are
        # done when no run sees a smaller one ahead
        left = state.join(there, "root").agg(F.count_if("open").alias("n"), F.count_if(F.col("open") & (F.col("low_next") < F.col("low"))).alias("falling")).first()
        if left.n == 0 or (left.n == last and left.falling == 0):
            break
        last = left.n
        state = state.join(there, "root").select("run", F.col("next").alias("root"), F.least("low", "low_next").alias("low"), (F.col("open") & F.col("open_next")).alias("open"))
    state = state.withColumn("root", F.when(F.col("open"), F.col("low")).otherwise(F.col("root")))
    return written(runs_.join(state.select("run", F.col("root").alias("path")), "run").select("path", "doc", "rid", "pos", "length"), "paths")


def asked(covered: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, rid, wants): what each row is asked as a source, and the path runs that lie in it."""

    def mapper(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def parts() -> Iterator[np.ndarray]:
            for b in batches:
                flat = b.column("runs").flatten()
                out = np.zeros(len(flat), _ASKED)
                for c, field in (("doc", "sdoc"), ("rid", "srid"), ("pos", "spos"), ("length", "length"), ("path", "path")):
                    out[c] = flat.field(field).to_numpy(zero_copy_only=False)
                yield out

        def combine(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            records = distinct(records)
            return records, row_key(records)

        yield from flushed(parts(), combine)

    def reducer(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _lists(distinct(records), ["pos", "length", "path"], "wants")

    spans = covered.select(F.transform("runs", lambda r: F.struct(r["sdoc"], r["srid"], r["spos"], r["length"], F.lit(-1).cast("long").alias("path"))).alias("runs"))
    lies = found.select(F.array(F.struct(F.col("doc").alias("sdoc"), F.col("rid").alias("srid"), F.col("pos").alias("spos"), "length", "path")).alias("runs"))
    return exchange(spans.unionAll(lies), mapper, _ASKED, reducer, "doc long, rid long, wants array<struct<pos:long,length:long,path:long>>")


class Words:
    """The words of one text, for joined slices."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        gap = (starts[1:] - ends[:-1] != 1) | (data[ends[:-1]] != 32) if len(starts) > 1 else np.zeros(0, bool)
        self.odd = np.concatenate([[0], np.cumsum(gap)])

    def joined(self, a: int, b: int) -> bytes:
        """Words a .. b - 1, joined by one space."""
        if a >= b:
            return b""
        if self.odd[b - 1] == self.odd[a]:
            return self.data[self.starts[a] : self.ends[b - 1]].tobytes()
        return b" ".join(self.data[x:y].tobytes() for x, y in zip(self.starts[a:b], self.ends[a:b], strict=True))


def _arrays(item, *names: str) -> list[np.ndarray]:
    if not item.is_valid:
        return [np.zeros(0, np.int64)] * len(names)
    return [item.values.field(c).to_numpy(zero_copy_only=False) for c in names]


OUT = "doc long, n_words long, n_removed long, n_paths long, kept_text string, kept_sha256 string, part int, payload binary"


def checked(marked: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Per row of marked (doc, rid, text, runs, wants) its result, and packed rows with the digests of spans and sources.

    A run with a proof (its source's digest) is left out if its words have another one.
    """
    n = partitions(marked.sparkSession)
    proven = "proof" in marked.schema["runs"].dataType.elementType.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proofs: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x = distinct(np.array(proofs, _PROOF))
            moved = packed(x, proof_key(x), n)
            proofs.clear()
            if moved is not None:
                none = [pa.nulls(moved.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([*none, *moved.columns], names=[*names, "part", "payload"])

        names = ["doc", "n_words", "n_removed", "n_paths", "kept_text", "kept_sha256"]
        for part, doc, data, offsets in pieces(unsqueezed(batches)):
            starts, ends, first = S.words(data, offsets)
            rid = column(part, "rid")
            out: list[tuple] = []
            for i in range(part.num_rows):
                a, b = first[i], first[i + 1]
                words = Words(data, starts[a:b], ends[a:b])
                drop = np.zeros(b - a, bool)
                run = part.column("runs")[i]
                pos, length, sdoc, srid, spos, kind = _arrays(run, "pos", "length", "sdoc", "srid", "spos", "kind")
                proof = run.values.field("proof") if proven and run.is_valid else None
                on = np.zeros(b - a, bool)
                for k in range(len(pos)):
                    own = hashlib.md5(words.joined(pos[k], pos[k] + length[k] + window - 1)).digest()
                    if proof is not None and proof[k].is_valid and proof[k].as_py() != own:
                        continue
                    if not kind[k]:
                        drop[pos[k] : pos[k] + length[k] + window - 1] = True
                    on[pos[k] : pos[k] + length[k]] = True
                    proofs.append((sdoc[k], srid[k], spos[k], length[k], 0, int.from_bytes(own[:8]), int.from_bytes(own[8:])))
                at, size, path = _arrays(part.column("wants")[i], "pos", "length", "path")
                for k in np.flatnonzero(path >= 0):
                    on[at[k] : at[k] + size[k]] = True
                for k in np.flatnonzero(path < 0):
                    if on[at[k] : at[k] + size[k]].all():
                        own = hashlib.md5(words.joined(at[k], at[k] + size[k] + window - 1)).digest()
                        proofs.append((doc[i], rid[i], at[k], size[k], 1, int.from_bytes(own[:8]), int.from_bytes(own[8:])))
                s, e = S.runs(~drop)
                kept = b" ".join(words.joined(x, y) for x, y in zip(s, e, strict=True))
                out.append((b - a, int(drop.sum()), len(np.unique(path[path >= 0])), kept.decode() if keep_text else None, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            empty = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(doc), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), *empty], names=[*names, "part", "payload"])
            if len(proofs) >= 20_000:
                yield from flush()
        if proofs:
            yield from flush()

    return marked.mapInArrow(tidy(rows), OUT)


def proof_key(x: np.ndarray) -> np.ndarray:
    h = S.mix(x["sdoc"].view(U64) + S.mix(x["srid"].view(U64)))
    return S.mix(h + x["spos"].astype(U64) * U64(31) + x["length"].astype(U64))


def refuted(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sources some of whose spans have other words, with the source's digest; empty where the source gave none."""
    x = distinct(records)
    new = np.ones(len(x), bool)
    new[1:] = np.any([x[c][1:] != x[c][:-1] for c in ("sdoc", "srid", "spos", "length")], axis=0)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(x)))
    last = x[starts + counts - 1]  # the source's own, if it is there
    same = (x["high"] == np.repeat(last["high"], counts)) & (x["low"] == np.repeat(last["low"], counts))
    bad = ~np.logical_and.reduceat(same, starts) | (last["own"] == 0)
    last = last[bad]
    proof = [int(h).to_bytes(8) + int(v).to_bytes(8) if own else b"" for h, v, own in zip(last["high"], last["low"], last["own"], strict=True)]
    cols = [pa.array(last[c].astype(np.int64)) for c in ("sdoc", "srid", "spos", "length")]
    yield pa.RecordBatch.from_arrays([*cols, pa.array(proof, pa.binary())], names=["sdoc", "srid", "spos", "length", "proof"])


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 5, keep_text: bool = True, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc, n_words, n_removed, n_paths, kept_text, kept_sha256) of every row, and the repeated paths by their runs."""
    rows = told_apart(keyed(docs))
    spots, marks = screen(rows, window, gram, hot)
    found = written(edges(squeezed(rows, "rid").join(spots, ["doc", "rid"]), window, gram, marks), "edges")
    compacted = paths(found.where("left is not null"))
    covered = written(gather(found.where("part is not null").select("part", "payload"), _COVER, run_lists, RUNS), "covered")
    wants = written(asked(covered, compacted), "wants")

    def result(runs: DataFrame) -> DataFrame:
        marked = squeezed(rows, "rid").join(runs, ["doc", "rid"], "left").join(wants, ["doc", "rid"], "left")
        return written(checked(marked, window, keep_text), "kept")

    out = result(covered)
    bad = written(gather(out.where("part is not null").select("part", "payload"), _PROOF, refuted, "sdoc long, srid long, spos long, length long, proof binary"), "refuted")
    if not bad.isEmpty():  # hashes that collided: once more, with the digests of the sources concerned
        one = covered.select("doc", "rid", F.explode("runs").alias("r")).select("doc", "rid", "r.*").join(bad, ["sdoc", "srid", "spos", "length"], "left")
        runs = one.groupBy("doc", "rid").agg(F.collect_list(F.struct("pos", "length", "sdoc", "srid", "spos", "kind", "proof")).alias("runs"))
        out = result(runs)
    return out.where("part is null").drop("part", "payload"), compacted


def query(spark, sf_dir: str) -> DataFrame:
    """op10: digest of every document after the removal."""
    out, _ = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select(F.expr(f"nullif(doc, {NO_ID})").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: The same rows by brute force over all windows.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS lo FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (win) WHERE doc_id > lo),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT doc_id, count(h.p) AS n_removed, string_agg(CASE WHEN h.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
