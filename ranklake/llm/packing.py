"""Best-fit packing with certified bounds (operator 7).

Documents become token ids (a public tokenizer's, then ``END``); only those longer
than the sequence length are cut. Pieces are dealt to partitions of about
``GROUP`` pieces by a hash; each partition packs its pieces by best-fit decreasing.
A dual-feasible function maps lengths so that no packing can have a mapped sum over
one per bin; the largest rounded-up mapped sum over two families of them is a
lower bound that certifies a partition's bin count. Partitions whose count is above
their bound release their least filled bins, and all partitions their partly filled
ones; the released pieces are dealt anew and packed again, as long as that saves
bins. Every round touches only the released pieces.

Words are tokenized once each and remembered (a bounded memory in each worker);
texts with characters outside a plain set, or with special-token brackets, go to the
tokenizer whole. Both ways give the same ids.

Defined cases: null and empty texts are one END token; null and repeated doc_ids are
separate documents; equal lengths are ordered by their row's number, so the packing is
the same for the same files; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import tidy, written

SEQUENCE, END, GROUP, ROUNDS, REMEMBERED = 4096, 1, 4000, 8, 300_000
SLICE = 1 << 20
# The public tokenizer's rules that ``Words.cut`` stands for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ADDED = {"<|startoftext|>", "<|endoftext|>"}


# Latin-1 characters that those rules leave as they are but for case, and their classes: 0 space, 1 letter, 2 digit, 3 other.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xB2), *range(0xB4, 0xB9), 0xBB, *range(0xC0, 0x100)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 or (192 <= c <= 222 and c != 215) else c for c in range(256))
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[range(48, 58)] = 2


class Words(dict):
    """Packed ids of a word, from the tokenizer at first sight."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # words are split here only as this file's own rules split them; with other rules every text goes in whole
        rules = json.loads(self.tokenizer.to_str())
        split = rules["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern") if rules["pre_tokenizer"] else None
        self.splits = rules["normalizer"] == _NORMALIZER and split == {"Regex": _SPLIT} and {x["content"] for x in rules["added_tokens"]} <= _ADDED

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        """Adds the ids of new words. Each is one unit to the tokenizer, so a line of them is encoded at once."""
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            line = self.tokenizer.encode(b" ".join(part).decode("latin-1"), add_special_tokens=False)
            ids, owner = np.array(line.ids, "<u4").tobytes(), np.array(line.word_ids)
            ends = (4 * np.searchsorted(owner, np.arange(len(part)), "right")).tolist()
            a = 0
            for w, b in zip(part, ends, strict=True):
                self[w] = ids[a:b]
                a = b

    def found(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words. When too many are held, only these stay."""
        out = list(map(self.get, words))
        if None in out:
            if len(self) > REMEMBERED:
                self.clear()
                self.update((w, x) for w, x in zip(words, out, strict=True) if x is not None)
            new = [i for i, x in enumerate(out) if x is None]
            self.learn([words[i] for i in new])
            for i in new:
                out[i] = self[words[i]]
        return out

    @staticmethod
    def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in lower-case Latin-1: a clipped ending ('s, 't, 're, 've, 'm, 'll, 'd) where no other
        sign stands before it, a run of letters, a digit, or a run of other signs."""
        kind = _CLASS[data]
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        marks = np.flatnonzero(start & (data == 39))
        if len(marks):
            after = np.concatenate([data, np.zeros(2, np.uint8)])
            one, two = after[marks + 1], after[marks + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            stop = marks + np.where(long, 3, 2)
            clipped = short | long
            marks, stop = marks[clipped], stop[clipped]
            start[marks + 1] = False
            on = stop[stop < len(data)]
            start[on[kind[on] == 1]] = True
        space = kind == 0
        space[1:] &= kind[:-1] != 0
        at = np.flatnonzero(start | space)
        own = start[at]
        return at[own], np.append(at[1:], len(data))[own]

    def plain(self, raw: list[bytes]) -> list[bytes]:
        """Ids of plain texts in Latin-1: equal words (by a 64-bit hash within the list) are looked up once."""
        joined = b"\n".join(raw).translate(_LOWER)
        data = np.frombuffer(joined, np.uint8)
        starts, ends = self.cut(data)
        if not len(starts):
            return [b""] * len(raw)
        _, first, which = np.unique(S.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = self.found(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(sizes) - sizes
        counts = sizes[which]
        done = np.cumsum(counts)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[which] - (done - counts), counts) + np.arange(done[-1])].tobytes()
        stops = np.cumsum([len(x) + 1 for x in raw])
        cut = np.concatenate([[0], done])[np.searchsorted(starts, stops)] * 4
        return [ids[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        raw: dict[int, bytes] = {}
        for i, t in enumerate(texts):
            try:
                x = t.encode("latin-1") if self.splits and "<|" not in t else b"\0"
            except UnicodeEncodeError:
                x = b"\0"
            if x.translate(None, _PLAIN):
                out[i] = self.whole(t)
            else:
                raw[i] = x
        for i, ids in zip(raw, self.plain(list(raw.values())), strict=True):
            out[i] = ids
        return out


_workers: dict[str, Words] = {}


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): row tells all rows apart."""
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(tokenizer_path)
        if words is None:
            words = _workers[tokenizer_path] = Words(tokenizer_path)
        for b in (part for batch in batches for part in S.slices(batch, "text", SLICE)):
            out = []
            encoded = words.encode([x or "" for x in b.column("text").to_pylist()])
            for doc, row, ids in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    out.append((doc, row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    # a number of its own for each row, fixed when the pieces are written
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id())
    return rows.select("doc_id", "row", "text").mapInArrow(tidy(cut), "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int = SEQUENCE, counts: np.ndarray | None = None) -> int:
    """The best bound of two families of dual-feasible functions; counts says how often each length stands for one."""
    if not len(lengths):
        return 0
    count = np.zeros(size + 1, np.int64)
    np.add.at(count, lengths, 1 if counts is None else counts)
    x = np.arange(size + 1, dtype=np.int64)
    number, total = np.cumsum(count), np.cumsum(count * x)
    # lengths under a count as 0, those over size - a as whole bins, others as they are
    a = np.arange(0, size // 2 + 1)
    high = size - a
    below = np.maximum(a - 1, 0)
    middle = np.where(a > 0, total[high] - total[below], total[high])
    bounds = [int(np.max(number[size] - number[high] - (-middle // size)))]
    # k-fold rounding: a length whose (k + 1)-fold is no multiple of size rounds down to k-ths
    for k in range(1, 25):
        whole = (k + 1) * x
        mapped = np.where(whole % size == 0, x * k, (whole // size) * size)
        bounds.append(-(-int((count * mapped).sum()) // (k * size)))
    return max(bounds)


def best_fit(lengths: list[int], size: int = SEQUENCE) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, offset in it, fill of each bin); lengths in decreasing order."""
    room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has r free places
    where, offset, fill = [], [], []
    for n in lengths:
        ready = mask >> n
        if ready:
            r = n + (ready & -ready).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = size, len(fill)
            fill.append(0)
        where.append(b)
        offset.append(fill[b])
        fill[b] += n
        r -= n
        if r:
            room.setdefault(r, []).append(b)
            mask |= 1 << r
    return where, offset, fill


_PLACED = "row long, piece int, length long, part long, bin long, offset long, open boolean"


def _packed(items: DataFrame, size: int, keep: float) -> DataFrame:
    """Packs each part. open: the piece stands in a bin that the part would release."""

    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        key = [t.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "row", "length")]
        order = np.lexsort((*key[:2], -key[2]))
        t = t.take(pa.array(order))
        lengths = t.column("length").to_numpy()
        where, offset, fill = best_fit(lengths.tolist(), size)
        fill = np.array(fill)
        gap = len(fill) - lower_bound(lengths, size)
        release = fill < keep * size
        if gap > 0:
            release[np.argsort(fill, kind="stable")[: 4 * gap + 4]] = True
        where = np.array(where)
        return pa.table({c: t.column(c) for c in ("row", "piece", "length", "part")} | {"bin": where, "offset": np.array(offset, np.int64), "open": release[where]})

    return items.groupBy("part").applyInArrow(pack, _PLACED)


def pack(found: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """(row, piece, sequence_id, offset) of found (row, piece, length)."""
    settled = []
    items, before = found, None
    for turn in range(ROUNDS):
        n = items.count()
        if not n:
            break
        parts = max(1, -(-n // group))
        dealt = items.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(parts)))
        placed = _packed(dealt.select("row", "piece", "length", "part"), sequence, 0.98).withColumn("sequence_id", F.lit(turn << 56) + F.col("part") * F.lit(1 << 20) + F.col("bin"))
        placed = written(placed, "packed")
        released = placed.where("open")
        stats = released.agg(F.countDistinct("sequence_id").alias("bins"), F.sum("length").alias("length"), F.count_if(F.col("bin") >= 0).alias("n")).first()
        fewest = -(-(stats["length"] or 0) // sequence)
        last = parts == 1 or stats["bins"] <= fewest or turn == ROUNDS - 1 or (before is not None and stats["bins"] >= before)
        settled.append(placed if last else placed.where("not open"))
        if last:
            break
        before = stats["bins"]
        items = released.select("row", "piece", "length")
    if not settled:
        return found.select("row", "piece", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("row", "piece", "sequence_id", "offset")


def least_sequences(found: DataFrame, sequence: int = SEQUENCE) -> int:
    """The certified bound: no packing of the pieces has fewer sequences. At most ``sequence`` counts reach the driver."""
    counts = found.groupBy("length").count().collect()
    return lower_bound(np.array([r["length"] for r in counts], np.int64), sequence, np.array([r["count"] for r in counts], np.int64)) if counts else 0


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece with its place, and in least_sequences the certified bound of the whole packing."""
    found = written(pieces(docs, tokenizer_path, sequence), "pieces")
    places = pack(found.select("row", "piece", "length"), sequence)
    out = found.join(places, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return out.withColumn("least_sequences", F.lit(least_sequences(found, sequence)).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the place of every piece of every document."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
