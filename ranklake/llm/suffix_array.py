"""Repeated byte strings by a distributed difference-cover suffix sort (operator 6).

Every text is its UTF-8 bytes. A byte goes if a ``LENGTH``-byte string over it also
starts in a document with a smaller doc_id.

Plan:
1. Winnowed fingerprints of ``GRAM``-byte strings (every LENGTH bytes hold one) screen the
   places that may repeat; equal fingerprints are combined in their map task first.
2. Windows whose smallest gram is such a place, and no others, can repeat. They form
   stretches, cut where the smallest gram changes, that go to the partition of that
   gram: equal windows always meet.
   Equal stretches are combined in the map task and again in the partition, so
   copies of one passage are sorted once.
3. In each partition the different stretches form one string whose suffixes are sorted by
   the difference cover {1, 2} modulo 3: sampled positions get names by their first
   characters, triples of names are sorted and named again until a name covers LENGTH
   bytes, and the remaining suffixes are merged in by their first byte and the rank
   that follows. Neighbours in the order that agree in LENGTH bytes form classes, and
   the smallest document of a class decides.
4. Covered runs are gathered by document and cut out.

No partition holds more than its share of stretches, and it is sorted in blocks of
about ``BLOCK`` bytes that keep windows of one gram together.

Defined cases: a null text is empty; a null doc_id sorts before all others; rows with
one doc_id never cover each other; texts under LENGTH bytes stay whole; cuts may fall
inside a character, so kept bytes are returned as binary; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import PACKED, decode, encode, gather, groups, packed, partitions, squeezed, tidy, unsqueezed, written
from .substring import _FINGER, HOT, NO_ID, column, combine_local, is_hot, keyed, own_minimum, pieces, row_key, row_starts, spots_of, told_apart

U64 = np.uint64
LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1
SLICE, FLUSH, BLOCK = 256 << 10, 12 << 20, 1 << 20

_STRETCH = np.dtype([("text", "<u8"), ("home", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("length", "<i4"), ("known", "<i4"), ("at", "<i8")])
COVER = np.dtype([("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4"), ("length", "<i4")])
RUNS = "doc long, rid long, runs array<struct<pos:long,length:long>>"


# ---- the suffix sort ---------------------------------------------------------


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of 64-bit keys, equal keys alike, and the number of different ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.cumsum(new)
    out = np.empty(len(keys), np.int64)
    out[order] = rank
    return out, int(rank[-1]) if len(rank) else 0


def suffix_order(text: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """The order of the wanted suffixes of ``text`` (all, without a mask) by at least their first ``depth`` bytes.

    Names are given only where they are used: at the wanted places and the two after each, and, a level down, at the
    places that make up their triples.
    """
    n = len(text)
    t = np.zeros(n + 3 * max(depth, 24) + 16, U64)
    t[:n] = text.astype(U64) + U64(1)
    if wanted is None:
        wanted = np.ones(n, bool)
    sampled = np.arange(len(t)) % 3 != 0
    used = np.zeros(len(t), bool)
    for k in range(3):
        used[k : n + k] |= wanted
    levels = [used & sampled]
    covers = [6]
    while covers[-1] < depth:
        covers.append(covers[-1] * 3)
    for step in covers[-2::-1]:
        below = levels[0].copy()
        below[step:] |= levels[0][:-step]
        below[2 * step :] |= levels[0][: -2 * step]
        levels.insert(0, below)
    # six characters of nine bits: the first names of the sample
    two = (t[:-1] << U64(9)) | t[1:]
    six = (two[:-4] << U64(36)) | (two[2:-2] << U64(18)) | two[4:]
    rank = np.zeros(len(t) + 2 * covers[-1], np.int64)
    sample = np.flatnonzero(levels[0][: len(six)])
    names, many = _names(six[sample])
    rank[sample] = names
    for covered, level in zip(covers, levels[1:], strict=False):
        if many == len(sample):
            break
        sample = np.flatnonzero(level[: len(six)])
        a, b, c = rank[sample], rank[sample + covered], rank[sample + 2 * covered]
        if many < (1 << 21) - 1:
            names, many = _names(((a << 42) | (b << 21) | c).astype(U64))
        else:
            pair, _ = _names((a.astype(U64) << U64(32)) | b.astype(U64))
            names, many = _names((pair.astype(U64) << U64(32)) | c.astype(U64))
        rank = np.zeros(len(rank), np.int64)
        rank[sample] = names
    place = np.flatnonzero(wanted)
    rest = place[place % 3 == 0]
    key = lambda i: (t[i] << U64(32)) | rank[i + 1].astype(U64)
    key2 = lambda i: (t[i] << U64(41)) | (t[i + 1] << U64(32)) | rank[i + 2].astype(U64)
    rest_keys = key(rest)
    rest_order = np.argsort(rest_keys, kind="stable")
    rest = rest[rest_order]
    chosen = place[place % 3 != 0]
    by_rank = chosen[np.argsort(rank[chosen], kind="stable")]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    # ties below the sorted depth may stand in any order, but keys must ascend for the search
    before = np.searchsorted(np.maximum.accumulate(key(ones)) if len(ones) else rest_keys[:0], rest_keys[rest_order])
    before += np.searchsorted(np.maximum.accumulate(key2(twos)) if len(twos) else rest_keys[:0], key2(rest))
    before = np.maximum.accumulate(before)
    out = np.empty(len(place), np.int64)
    at = before + np.arange(len(rest))
    taken = np.zeros(len(place), bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = by_rank
    return out


def window_classes(text: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` (starts) in suffix order, and the places in it where a class of equal ``length`` bytes begins."""
    wanted = np.zeros(len(text), bool)
    wanted[windows] = True
    order = suffix_order(text, length, wanted)
    padded = np.zeros(len(text) + 8, U64)
    padded[: len(text)] = text
    w = (padded[:-1] << U64(8)) | padded[1:]
    w = (w[:-2] << U64(16)) | w[2:]
    w = (w[:-4] << U64(32)) | w[4:]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for at in [*range(0, length - 7, 8), length - 8]:
        x = w[order + at]
        new[1:] |= x[1:] != x[:-1]
    return order, np.flatnonzero(new)


# ---- the distributed part ----------------------------------------------------


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    return pieces(batches, SLICE)


def _gram_hashes(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of GRAM bytes at each place; those that run over a text's end are the largest value."""
    n = len(sums) - 1 - GRAM + 1
    if n <= 0:
        return np.zeros(0, U64)
    _, down = S._table(len(sums), S._BASE)
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:n]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    edge = np.zeros(n + 1, np.int8)
    stop = offsets[1:]
    np.add.at(edge, np.clip(stop - GRAM + 1, 0, n), 1)
    np.add.at(edge, np.clip(stop, 0, n), -1)
    # texts shorter than a gram mark from before their start, which only adds marks at a former text's end
    h[np.cumsum(edge[:n]) > 0] = U64(2**64 - 1)
    return h


def screen(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, np.ndarray]:
    """(doc, rid, spots): byte places whose fingerprint starts in two or more documents; and the hot fingerprints."""
    top = U64(2**64 - 1)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part, doc, data, offsets in _sliced(batches):
            if len(data) < LENGTH:
                continue
            h = _gram_hashes(S.prefix(data), offsets)
            low = S.sliding_min(h, REACH)
            pad = np.zeros(len(h) + REACH - 1, U64)
            pad[REACH - 1 : REACH - 1 + len(low)] = low
            at = np.flatnonzero((~S.sliding_min(~pad, REACH) == h) & (h != top))
            owner = np.searchsorted(offsets, at, "right") - 1
            out = np.zeros(len(at), _FINGER)
            out["hash"], out["doc"], out["rid"], out["pos"] = S.mix(h[at]), doc[owner], column(part, "rid")[owner], at - offsets[owner]
            yield out

    return spots_of(docs, mapper, hot)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Places whose LENGTH bytes lie in one text."""
    edge = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    some = size >= LENGTH
    np.add.at(edge, offsets[:-1][some], 1)
    np.add.at(edge, offsets[1:][some] - LENGTH + 1, -1)
    return np.cumsum(edge[:n]) > 0


def _stretches(part: pa.RecordBatch, doc: np.ndarray, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Runs of windows that may repeat and share their smallest gram; ``at`` is their place in ``data``. Around a hot gram
    each window stands alone, and its home follows from all its bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, _STRETCH)
    sums = S.prefix(data)
    h = _gram_hashes(sums, offsets)
    low = S.sliding_min(h, REACH)
    mask = own_minimum(part.column("spots"), offsets, h, low, REACH)
    # a window stays in its text
    mask &= _inside(offsets, len(low))
    at = np.flatnonzero(mask)
    if not len(at):
        return np.zeros(0, _STRETCH)
    owner = np.searchsorted(offsets, at, "right") - 1
    home = low[at]
    alone = is_hot(S.mix(home), hot)
    if alone.any():
        home = np.where(alone, S.mix(S.range_hash(sums, at, at + LENGTH)), home)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (home[1:] != home[:-1]) | (owner[1:] != owner[:-1]) | alone[1:]
    first = np.flatnonzero(new)
    out = np.zeros(len(first), _STRETCH)
    out["length"] = np.diff(np.append(first, len(at)))
    out["at"] = at[first]
    out["home"] = home[first]
    out["text"] = S.mix(S.range_hash(sums, out["at"], out["at"] + out["length"] + LENGTH - 1) + out["length"].astype(U64))
    out["doc"], out["rid"], out["pos"] = doc[owner[first]], column(part, "rid")[owner[first]], at[first] - offsets[owner[first]]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _differ(text: np.ndarray, at: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which byte ranges at ``at`` are not those at ``other``, about SLICE bytes at a time."""
    out = np.zeros(len(at), bool)
    total = np.cumsum(size)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 4 * SLICE, "right")))
        unlike = text[_ranges(at[a:b], size[a:b])] != text[_ranges(other[a:b], size[a:b])]
        out[a:b] = np.logical_or.reduceat(unlike, np.cumsum(size[a:b]) - size[a:b])
        a = b
    return out


def settle_hashes(records: np.ndarray, text: np.ndarray) -> None:
    """Makes records of one ``text`` hash have the same bytes: those unlike the first of their group get hashes of
    their bytes."""
    while len(records):
        order, starts = groups(records["text"])
        x = records[order]
        counts = np.diff(np.append(starts, len(x)))
        first = np.repeat(starts, counts)
        again = np.flatnonzero(np.arange(len(x)) != first)
        size = x["length"].astype(np.int64) + LENGTH - 1
        unlike = size[again] != size[first[again]]
        same = again[~unlike]
        odd = np.concatenate([again[unlike], same[_differ(text, x["at"][same], x["at"][first[same]], size[same])]])
        if not len(odd):
            return
        for i in odd:
            own = text[x["at"][i] : x["at"][i] + size[i]].tobytes()
            records["text"][order[i]] = int.from_bytes(hashlib.blake2b(own, digest_size=8, salt=bytes([len(odd) % 256])).digest())


_HEAD = np.dtype([(c, t) for c, (t, _) in _STRETCH.fields.items() if c != "at"])


def _pack_stretches(records: np.ndarray, text: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Settled stretches travel without their text."""
    keys = S.mix(records["home"])
    part = ((keys >> U64(20)) % U64(n)).astype(np.int64)
    order = np.lexsort((records["pos"], records["rid"], records["doc"], part))
    records, part = records[order], part[order]
    used, starts = np.unique(part, return_index=True)
    press = zstandard.ZstdCompressor(level=3)
    blobs = []
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        own = records[a:b]
        head = np.empty(len(own), _HEAD)
        for c in _HEAD.names:
            head[c] = own[c]
        open_ = own[own["known"] != 1]
        body = text[_ranges(open_["at"], open_["length"].astype(np.int64) + LENGTH - 1)].tobytes() if len(open_) else b""
        blobs.append(np.array([len(own)], np.int64).tobytes() + encode(head) + press.compress(body))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "payload"])


def _unpack_stretches(blobs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    heads, texts, shift = [], [], 0
    press = zstandard.ZstdDecompressor()
    for b in blobs:
        n = int(np.frombuffer(b[:8].tobytes(), np.int64)[0])
        end = 8 + n * _HEAD.itemsize
        head = decode(b[8:end], _HEAD)
        out = np.zeros(n, _STRETCH)
        for c in _HEAD.names:
            out[c] = head[c]
        size = np.where(out["known"] != 1, out["length"].astype(np.int64) + LENGTH - 1, 0)
        out["at"] = shift + np.cumsum(size) - size
        heads.append(out)
        texts.append(np.frombuffer(press.decompress(b[end:].tobytes()), np.uint8))
        shift += len(texts[-1])
    return np.concatenate(heads), np.concatenate(texts)


def _covers(doc, rid, pos, length) -> np.ndarray:
    out = np.empty(len(doc), COVER)
    out["doc"], out["rid"], out["pos"], out["length"] = doc, rid, pos, length
    return out


def _decided(records: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """Covered runs of the open stretches of one partition."""
    settle_hashes(records, text)
    order, starts = groups(records["text"])
    records = records[order]
    counts = np.diff(np.append(starts, len(records)))
    low = np.repeat(np.minimum.reduceat(records["doc"], starts), counts)
    later = records[records["doc"] > low]
    yield _covers(later["doc"], later["rid"], later["pos"], later["length"])
    owners = records["doc"] == low
    group = np.repeat(np.arange(len(starts)), counts)[owners]
    owners = records[owners]
    lead = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    # one text for each group; blocks hold whole homes
    by_home = np.argsort(owners["home"][lead], kind="stable")
    homes = owners["home"][lead][by_home]
    sizes = owners["length"][lead][by_home].astype(np.int64) + LENGTH
    home_ends = np.append(np.flatnonzero(homes[1:] != homes[:-1]) + 1, len(homes))
    total = np.cumsum(sizes)
    members = np.append(lead, len(owners))
    a = 0
    while a < len(homes):
        done = total[a - 1] if a else 0
        b = int(home_ends[np.searchsorted(home_ends, min(max(int(np.searchsorted(total, done + BLOCK)), a + 1), len(homes)))])
        chosen = by_home[a:b]
        a = b
        x = owners[lead[chosen]]
        if len(x) < 2:
            continue
        length = x["length"].astype(np.int64)
        bytes_ = length + LENGTH - 1
        begin = np.cumsum(bytes_) - bytes_
        block = text[_ranges(x["at"], bytes_)]
        of = np.repeat(np.arange(len(x)), bytes_)
        windows = _ranges(begin, length)
        ordered, first = window_classes(block, windows)
        doc = x["doc"][of[ordered]]
        smallest = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(ordered))))
        hit = np.zeros(len(block), bool)
        hit[ordered[smallest < doc]] = True
        s, e = S.runs(hit)
        # windows of different texts never touch: each text ends with LENGTH - 1 places that start none
        t = of[s]
        copies = members[chosen[t] + 1] - members[chosen[t]]
        who = owners[_ranges(members[chosen[t]], copies)]
        yield _covers(who["doc"], who["rid"], who["pos"] + np.repeat(s - begin[t], copies), np.repeat(e - s, copies))


def run_lists(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document with its covered runs, joined where they touch."""
    x = records[np.lexsort((records["pos"], records["rid"], records["doc"]))]
    if not len(x):
        return
    new = np.ones(len(x), bool)
    new[1:] = x["pos"][1:] > x["pos"][:-1] + x["length"][:-1]
    new[row_starts(x)] = True
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(x["pos"].astype(np.int64) + x["length"], first)
    x = x[first]
    cut = row_starts(x)
    run = pa.StructArray.from_arrays([pa.array(x["pos"].astype(np.int64)), pa.array(stop - x["pos"])], names=["pos", "length"])
    yield pa.RecordBatch.from_arrays([pa.array(x["doc"][cut]), pa.array(x["rid"][cut]), pa.ListArray.from_arrays(pa.array(np.append(cut, len(x)).astype(np.int32)), run)], names=["doc", "rid", "runs"])


def covered(marked: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc, rid, runs): for each document the runs (pos, length) of windows that also start in a smaller one."""
    n = partitions(marked.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            records = np.concatenate(held)
            if len(records):
                text = np.concatenate(texts)
                settle_hashes(records, text)
                records, _ = combine_local(records, records["text"].copy())
                yield from _pack_stretches(records, text, n)

        for part, doc, data, offsets in _sliced(unsqueezed(batches)):
            x = _stretches(part, doc, data, offsets, hot)
            x["at"] += size
            held.append(x)
            texts.append(data)
            size += len(data)
            if size >= FLUSH:
                yield from flush()
                held, texts, size = [], [], 0
        if held:
            yield from flush()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(x.as_buffer(), np.uint8) for b in batches for x in b.column(1)]
        if not blobs:
            return
        records, text = _unpack_stretches(blobs)
        del blobs
        settled = records["known"] == 1
        x = records[settled]
        out = [_covers(x["doc"], x["rid"], x["pos"], x["length"])]
        if not settled.all():
            out += list(_decided(records[~settled], text))
        found = np.concatenate(out)
        found = found[np.lexsort((found["pos"], found["rid"], found["doc"]))]
        rows = packed(found, row_key(found), n)
        if rows is not None:
            yield rows

    moved = marked.mapInArrow(tidy(mapped), PACKED).repartitionById(n, "part").mapInArrow(tidy(reduced), PACKED)
    return gather(moved, COVER, run_lists, RUNS)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, text, runs): compressed texts with their covered runs."""
    rows = told_apart(keyed(docs))
    spots, marks = screen(rows, hot)
    runs = written(covered(squeezed(rows, "rid").join(spots, ["doc", "rid"]), marks), "covered")
    return squeezed(rows, "rid").join(runs, ["doc", "rid"], "left")


def digests(marked: DataFrame, keep: bool = True) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, the kept bytes (if asked for) and their digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, doc, data, offsets in _sliced(unsqueezed(batches)):
            lists = part.column("runs")
            out = []
            for i in range(part.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                drop = np.zeros(len(own), bool)
                if lists[i].is_valid:
                    v = lists[i].values
                    for p, n in zip(v.field("pos").to_numpy(), v.field("length").to_numpy(), strict=True):
                        drop[p : p + n + LENGTH - 1] = True
                kept = own[~drop].tobytes()
                out.append((len(own), int(drop.sum()), len(S.runs(drop)[0]), kept if keep else None, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(doc), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return written(marked.mapInArrow(tidy(rows), "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"), "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: digest of every document after the removal."""
    out = digests(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")), keep=False)
    return out.select(F.expr(f"nullif(doc, {NO_ID})").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same rows by brute force over all windows.
SQL = r"""
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (octet_length(encode(coalesce(text, ''))))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
m AS (SELECT win, min(doc_id) AS lo FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)),
s AS (SELECT g.doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY g.doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g JOIN m USING (win) WHERE g.doc_id > lo),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept
 FROM p JOIN n USING (doc_id) JOIN (SELECT doc_id, max(e) AS last FROM r GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)
"""
