"""Audio columns (operator 9): lossless 8-bit samples, resampling, log-mel filterbanks, segments, tensors.

The bytes of a text are the payload of a mono 8-bit PCM WAVE stream; the stream is
what a media column stores, and all features come from the samples read back from
it. ``describe`` adds for each row:

- the media column is a table of streams; features come from the table as it is read back;
- digests of the payload, of its last bytes and of the stored stream;
- polyphase resampling by ``UP`` / ``DOWN`` with a windowed sine filter, as one product of
  overlapping input blocks with a banded matrix;
- overlapped log-mel frames (``FRAME`` samples, ``HOP`` apart);
- hysteresis segmentation of the frame energy: a segment opens above the upper and
  closes below the lower threshold, both relative to the row's median;
- ``tensors``: one ``MELS`` x ``PATCH`` patch for each PATCH frames of a segment (the last one
  padded with the floor) with its time span. ``fixed_shape`` turns the column of an
  Arrow table into Arrow's fixed-shape tensor type.

Each row is computed alone and in double precision, and features are rounded, so
equal texts give equal values wherever they stand. Defined cases: null text is
empty; an empty payload is padded to one block like any other; a text of any length
is processed whole; repeated rows give repeated rows; other columns are ignored.
A worker holds one Arrow batch, of 64 MB by Spark's default, and the results of
about ``SLICE`` bytes of text, or of one longer text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import tidy, written

BLOCK, PAD = 576, 255
RATE, UP, DOWN = 8000, 2, 3
TAPS = 48
FRAME, HOP, MELS, PATCH = 256, 128, 16, 32
FLOOR = -10.0
OPEN_DB, CLOSE_DB = 1.0, -1.0
_STEP = 48
SLICE = 1 << 20


def payload(text: bytes) -> bytes:
    """The text's bytes, padded to a positive multiple of BLOCK."""
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text + bytes([PAD]) * (size - len(text))


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAVE stream."""
    form = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(form)) + form


def from_wave(stream: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit PCM WAVE stream; other chunks are skipped."""
    if stream[:4] != b"RIFF" or stream[8:12] != b"WAVE":
        raise ValueError("not a WAVE stream")
    at, rate = 12, None
    while at + 8 <= len(stream):
        name, size = stream[at : at + 4], struct.unpack_from("<I", stream, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stream, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, stream[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _resampler() -> np.ndarray:
    """The banded matrix from TAPS + _STEP inputs to _STEP * UP / DOWN outputs."""
    width = TAPS * UP
    t = np.arange(-width // 2, width // 2 + 1)
    cutoff = 1 / max(UP, DOWN)
    kernel = np.sinc(t * cutoff) * cutoff * UP * np.hanning(len(t))
    outputs = _STEP * UP // DOWN
    matrix = np.zeros((_STEP + TAPS, outputs))
    for o in range(outputs):
        centre = o * DOWN
        for i in range(_STEP + TAPS):
            k = (i - TAPS // 2) * UP - centre + width // 2
            if 0 <= k < len(kernel):
                matrix[i, o] = kernel[k]
    return matrix


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN of its rate; its length is taken up to a multiple of _STEP with zeros."""
    blocks = -(-len(x) // _STEP)
    padded = np.zeros(blocks * _STEP + TAPS)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    return (np.lib.stride_tricks.sliding_window_view(padded, _STEP + TAPS)[::_STEP] @ _resampler()).ravel()


@lru_cache(maxsize=1)
def _mel() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, from bins to MELS bands."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    out = np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)
    return out / np.maximum(out.sum(axis=0), 1e-9)


_WINDOW = np.hanning(FRAME + 1)[:-1]


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) in log10 power, at least FLOOR; the last frame is padded with zeros."""
    frames = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME)
    padded[: len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    spectrum = np.fft.rfft(view * _WINDOW, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log10(np.maximum(power @ _mel(), 10.0**FLOOR))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges between a rise above the upper and a fall below the lower threshold."""
    middle = np.median(energy)
    mark = np.where(energy >= middle + OPEN_DB / 10, 1, np.where(energy < middle + CLOSE_DB / 10, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    state = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edge = np.diff(np.concatenate([[0], state.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def analysed(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resample(x - x.mean()))
    mel = np.round(mel, 3) + 0.0
    return mel, segments(np.round(mel.mean(axis=1), 6))


def patches(mel: np.ndarray, spans: list[tuple[int, int]]) -> list[dict]:
    step = HOP * DOWN / (RATE * UP)
    out = []
    for a, b in spans:
        for at in range(a, b, PATCH):
            patch = np.full((MELS, PATCH), FLOOR, np.float32)
            part = mel[at : min(at + PATCH, b)]
            patch[:, : len(part)] = part.T
            out.append({"start_s": at * step, "end_s": (at + len(part)) * step, "mel": patch.ravel().tolist()})
    return out


def tensors_digest(tensors: list[dict]) -> str:
    """SHA-256 of each tensor's span and its values, in order."""
    whole = hashlib.sha256()
    for t in tensors:
        whole.update(np.array([t["start_s"], t["end_s"]], "<f8").tobytes())
        whole.update(np.array(t["mel"], "<f4").tobytes())
    return whole.hexdigest()


def feature_text(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    means = ",".join(f"{v:.2f}" for v in mel.mean(axis=0))
    spans_crc = zlib.crc32(np.array(spans, "<i8").tobytes())
    return f"frames={len(mel)};segments={len(spans)};active={sum(b - a for a, b in spans)};spans={spans_crc:08x};mel={means}"


_FIELDS = {
    "n_bytes": ("long", pa.int64()),
    "payload_bytes": ("long", pa.int64()),
    "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()),
    "media_bytes": ("long", pa.int64()),
    "media_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()),
}
_TENSOR = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", pa.list_(pa.float32()))]))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the media column of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in S.slices(batch, "text", SLICE)):
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.large_binary())]
            media = pa.array([to_wave(payload(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(rows), "doc_id long, n_bytes long, media binary")


def described(media: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id and the digests of every row of ``stored``, from the samples read back, with the tensors if asked for."""
    fields = dict(_FIELDS)
    if tensors:
        fields["tensors"] = ("array<struct<start_s:double,end_s:double,mel:array<float>>>", _TENSOR)
        fields["n_tensors"], fields["tensors_sha256"] = ("long", pa.int64()), ("string", pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in S.slices(batch, "media", SLICE)):
            out: dict[str, list] = {c: [] for c in fields}
            for n, x in zip(b.column("n_bytes").to_pylist(), b.column("media"), strict=True):
                stream = x.as_buffer().to_pybytes()
                _, back = from_wave(stream)
                mel, spans = analysed(back)
                values = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature_text(mel, spans)]
                for c, v in zip(_FIELDS, values, strict=True):
                    out[c].append(v)
                if tensors:
                    found = patches(mel, spans)
                    out["tensors"].append(found)
                    out["n_tensors"].append(len(found))
                    out["tensors_sha256"].append(tensors_digest(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c], t) for c, (_, t) in fields.items())], names=["doc_id", *fields])

    schema = "doc_id long, " + ", ".join(f"{c} {t}" for c, (t, _) in fields.items())
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(rows), schema)


def describe(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """``described`` of the rows' media column, which is written to a table in the shared folder and read back."""
    return described(written(stored(docs), "media"), tensors)


def fixed_shape(table: pa.Table) -> pa.Table:
    """One row for each patch of a ``describe`` table: doc_id, start_s, end_s and a fixed-shape tensor."""
    column = table.column("tensors").combine_chunks()
    parents = pa.compute.list_parent_indices(column)
    flat = column.flatten()
    kind = pa.fixed_shape_tensor(pa.float32(), (MELS, PATCH), dim_names=("mel", "frame"))
    storage = pa.FixedSizeListArray.from_arrays(flat.field("mel").flatten(), MELS * PATCH)
    ids = table.column("doc_id").combine_chunks().take(parents)
    return pa.table({"doc_id": ids, "start_s": flat.field("start_s"), "end_s": flat.field("end_s"), "mel": pa.ExtensionArray.from_storage(kind, storage)})


def query(spark, sf_dir: str) -> DataFrame:
    """op9: digests and the feature string of every document's stored stream, the number of its tensors and a digest of
    their values and time spans."""
    return describe(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tensors")
