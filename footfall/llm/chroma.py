"""Chroma audio fingerprints of a media column, and their alignment.

A recording (16-bit mono WAV bytes) is cut into overlapping frames. The power of each frame is folded onto
twelve pitch classes, smoothed over time and normalised. An integral image of these frames
makes the sum of any rectangle four look-ups; sixteen rectangle filters compare sums, and each
answer is quantised to two bits in Gray code, so that every frame from the first full
window on gives one packed 32-bit integer.

Two recordings are aligned by the histogram of place differences of integers that agree in
their upper or in their lower ``KEY_BITS`` bits; differences with ``LEAST_HITS`` such hits are judged by the share of
bits that differ over the overlap. (Against brute force over all offsets, 98 % of the noisy copies that differ in at
most ``MOST_ERROR`` of their bits are found; a test holds it above 0.9.) A stated set of query recordings is searched against all, in
blocks of queries, and every pair of a query and a recording within the limits is reported. Recordings with equal fingerprints are one class, of which one is searched.

Defined results: null, broken or too short audio has no integers and no match; repeated rows
are rows of one class; of equally good alignments the one with more hits, then the lesser query and offset, is taken; a long
recording is worked on whole, in one row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import textops as T
from footfall.llm.common import cut, table

RATE, FRAME, HOP = 8000, 1024, 256
LOW, HIGH = 110.0, 3520.0
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
SPAN = 16
#: Six shapes: whole, top against bottom, left against right, quarters, middle row, middle column.
KINDS = 6
#: Two integers hit if their upper or their lower KEY_BITS agree; unrelated melodies differ in 0.35 of their bits and more.
KEY_BITS, LEAST_HITS, MOST_ERROR = 20, 2, 0.22
QUERY_BLOCK = 4096


def filters() -> list[tuple[int, int, int, int]]:
    """Shape, first pitch class, pitch classes and frames of the sixteen filters, by rule."""
    return [((k * 5 + 2) % KINDS, (k * 7) % 9, 2 + (k * 5) % 11 % (12 - (k * 7) % 9 - 1), 4 + (k * 3) % (SPAN - 3)) for k in range(16)]


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    raw = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(raw)) + raw


def samples_of(audio: bytes | None) -> np.ndarray:
    """Samples at RATE; empty if the bytes are no 16-bit PCM WAV."""
    none = np.zeros(0, np.float32)
    if not audio or len(audio) < 44 or audio[:4] != b"RIFF" or audio[8:12] != b"WAVE":
        return none
    at, rate, channels, bits, data = 12, 0, 0, 0, b""
    while at + 8 <= len(audio):
        name, size = audio[at : at + 4], struct.unpack("<I", audio[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(audio):
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", audio[at + 8 : at + 24])
        elif name == b"data":
            data = audio[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if bits != 16 or not rate or not channels or len(data) < 2 * channels:
        return none
    x = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(axis=1).astype(np.float32)
    if rate != RATE:
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x).astype(np.float32)
    return x


_WINDOW = np.hanning(FRAME).astype(np.float32)
_FREQUENCY = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_FREQUENCY >= LOW) & (_FREQUENCY < HIGH))
_FOLD = np.zeros((len(_USED), 12), np.float32)
_FOLD[np.arange(len(_USED)), np.round(12 * np.log2(_FREQUENCY[_USED] / 440.0)).astype(int) % 12] = 1


def chroma(x: np.ndarray) -> np.ndarray:
    """Smoothed, normalised pitch-class frames."""
    n = (len(x) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)[:, _USED]).astype(np.float32) ** 2
    raw = power @ _FOLD
    m = n - len(SMOOTH) + 1
    out = sum(w * raw[k : k + m] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0).astype(np.float32)


def pack(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place of the window over the frames."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return total[x1 : x1 + n, y1] - total[x0 : x0 + n, y1] - total[x1 : x1 + n, y0] + total[x0 : x0 + n, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        if kind == 0:
            part = 0.5 * area(0, w, 0, 12) * h / 6
        elif kind == 1:
            part = 2 * area(0, w, y, y + h // 2)
        elif kind == 2:
            part = 2 * area(0, w // 2, y, y + h)
        elif kind == 3:
            part = 2 * (area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h))
        elif kind == 4:
            part = 3 * area(0, w, y + h // 3, y + h - h // 3)
        else:
            part = 3 * area(w // 3, w - w // 3, y, y + h)
        value = np.log((1 + part) / (1 + whole))
        level = np.searchsorted([-0.15, 0.0, 0.15], value, side="right").astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprint(audio: bytes | None) -> np.ndarray:
    return pack(chroma(samples_of(audio)))


def render(vector: list[float] | None) -> bytes | None:
    """A short melody from a vector: each value is a note, its pitch by the value's step on a scale."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if a is None else a for a in vector], np.float64), posinf=0, neginf=0)
    note = np.floor((np.clip(v, -1, 1) + 1) * 30).astype(int) % 36
    tone = 262.0 * 2 ** (note / 12)
    t = np.arange(512) / RATE
    wave = np.sin(2 * np.pi * tone[:, None] * t) + 0.3 * np.sin(4 * np.pi * tone[:, None] * t)
    return wav((wave * np.hanning(512) * 8000).ravel())


def with_audio(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The media column: key and audio, rendered from a vector column."""
    src = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([render(v) for v in part.column("v").to_pylist()], pa.binary())], names=["key", "audio"])

    return src.mapInArrow(T.lean(own), "key long, audio binary")


def fingerprints(media: DataFrame, key: str = "key", audio: str = "audio") -> DataFrame:
    """key and ints (packed fingerprint, little-endian 32-bit) of every recording."""
    src = media.select(F.col(key).alias("key"), F.col(audio).alias("audio"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([fingerprint(a).astype("<u4").tobytes() for a in b.column("audio").to_pylist()], pa.binary())], names=["key", "ints"])

    return src.mapInArrow(T.lean(own), "key long, ints binary")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where a[i] meets b[i + offset]; 1 without a common part."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo))


def keys_of(ints: np.ndarray) -> np.ndarray:
    """Upper keys of all integers, then their lower ones, marked."""
    return np.concatenate([ints >> np.uint32(32 - KEY_BITS), (ints & np.uint32((1 << KEY_BITS) - 1)) | np.uint32(1 << KEY_BITS)])


class Block:
    """A block of query fingerprints, sorted by their keys."""

    def __init__(self, keys: list[int], ints: list[bytes]):
        self.names = np.array(keys, np.int64)
        self.prints = [np.frombuffer(x, "<u4") for x in ints]
        size = [len(p) for p in self.prints]
        key = keys_of(np.concatenate(self.prints) if self.prints else np.zeros(0, np.uint32))
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.own = np.tile(np.repeat(np.arange(len(size)), size), 2)[order]
        self.place = np.tile(np.concatenate([np.arange(n) for n in size]) if size else np.zeros(0, np.int64), 2)[order]

    def matches(self, name: int, ints: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Query, offset, hits and bit error of every query's best alignment with another recording."""
        key = keys_of(ints)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        many = hi - lo
        if not many.any():
            return []
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        offset = self.place[at] - np.repeat(np.tile(np.arange(len(ints)), 2), many)
        cell, hits = np.unique(self.own[at] * (1 << 24) + offset + (1 << 23), return_counts=True)
        found: dict[int, tuple[float, int, int]] = {}
        for c, n in zip(cell[hits >= LEAST_HITS].tolist(), hits[hits >= LEAST_HITS].tolist(), strict=True):
            q, off = c >> 24, (c & ((1 << 24) - 1)) - (1 << 23)
            if self.names[q] == name:
                continue
            err = bit_error(ints, self.prints[q], off)
            if err <= MOST_ERROR and (q not in found or (err, -n, off) < found[q]):
                found[q] = (err, -n, off)
        return [(int(self.names[q]), off, -less, err) for q, (err, less, off) in found.items()]

    def best(self, name: int, ints: np.ndarray) -> tuple[int, int, int, float] | None:
        """The best of all queries' alignments."""
        return min(self.matches(name, ints), key=lambda m: (m[3], -m[2], m[0], m[1]), default=None)


def search(prints: DataFrame, queries, block: int = QUERY_BLOCK) -> DataFrame:
    """All alignments within the limits: key, class_id, match_id, match_offset, match_hits, bit_error, best.

    ``queries`` is a Column that is true for the rows to be searched for; a class of equal
    fingerprints is searched once, under its least key. Every recording has one row with its best
    match (``best``, no match_id where nothing aligns). Each further query class that aligns with a
    class of recordings is one row more, under the class's least key and not ``best``; the
    members of both classes are the rows with their class_id.
    """
    spark = prints.sparkSession
    named = prints.withColumn("h", F.xxhash64("ints")).withColumn("q", F.coalesce(queries, F.lit(False)))
    one = named.groupBy("h").agg(F.min("key").alias("class_id"), F.max("q").alias("q"), F.first("ints").alias("ints"))
    one = cut(one.withColumn("deal", F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1 << 30))))
    asked = one.filter("q AND octet_length(ints) > 0")
    blocks = -(-asked.count() // block)
    schema = "h long, match_id long, match_offset int, match_hits int, bit_error double"
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        span = (1 << 30) / blocks
        rows = asked.filter((F.col("deal") >= int(k * span)) & (F.col("deal") < int((k + 1) * span))).orderBy("class_id").select("class_id", "ints").collect()
        shared = spark.sparkContext.broadcast(Block([r["class_id"] for r in rows], [bytes(r["ints"]) for r in rows]))

        def own(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(i, *m) for i, (n, x) in enumerate(zip(b.column("class_id").to_pylist(), b.column("ints").to_pylist(), strict=True)) for m in shared.value.matches(n, np.frombuffer(x, "<u4"))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("h").take(pa.array([g[0] for g in got], pa.int64())), *[pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64()), 1)]],
                    names=["h", "match_id", "match_offset", "match_hits", "bit_error"],
                )

        found = found.unionByName(one.filter("octet_length(ints) > 0").select("h", "class_id", "ints").mapInArrow(T.lean(own), schema))
    found = cut(found)
    order = F.struct("bit_error", (-F.col("match_hits")).alias("less"), "match_id", "match_offset", "match_hits")
    best = found.groupBy(F.col("h").alias("bh")).agg(F.min(order).alias("m"))
    classes = one.select(F.col("h").alias("ch"), "class_id", F.col("ints").alias("class_ints")).join(best, F.col("ch") == F.col("bh"), "left")
    rows = named.join(classes.drop("class_ints"), F.col("h") == F.col("ch")).select("key", "class_id", "m.match_id", "m.match_offset", "m.match_hits", "m.bit_error", F.lit(True).alias("best"), "ints")
    more = found.join(classes, (F.col("h") == F.col("ch")) & (F.col("match_id") != F.col("m.match_id")))
    return rows.unionByName(more.select(F.col("class_id").alias("key"), "class_id", "match_id", "match_offset", "match_hits", "bit_error", F.lit(False).alias("best"), F.col("class_ints").alias("ints")))


def query(spark, sf_dir: str) -> DataFrame:
    media = with_audio(table(spark, sf_dir, "embeddings"))
    prints = cut(fingerprints(media))
    out = search(prints, F.col("key") % 100 == 0)
    return out.select(F.col("key").alias("vec_id"), F.floor(F.octet_length("ints") / 4).cast("long").alias("n_ints"), F.crc32("ints").alias("ints_crc32"), "class_id", "match_id", "match_offset", "match_hits", "bit_error", "best")
