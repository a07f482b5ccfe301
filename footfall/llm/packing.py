"""Packing token sequences by minimum bin slack.

Each document becomes its token ids and one end id. Full windows are cut off first; what is
left of a document is shorter than a window and stays whole. Only *how many* remainders have
each length matters for the plan, so the plan is made from a histogram of at most
``window - 1`` counts: the longest length opens a window, a bitset subset-sum dynamic
programme over the other lengths finds the reachable fill closest to capacity, the multiset
is read back from the stored bitsets, and the pattern is used as often as its counts allow.
Every use empties the supply of some length below what the pattern needs, so the plan has a
few thousand patterns at most, however many documents there are.

A piece's rank among the pieces of its length then tells pattern, window and offset by
arithmetic. Ranks come from counts by partition and length, not from a global sort.

Defined results: a null text is an empty text (its end id alone); every row is packed,
repeated rows too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm import textops as T
from footfall.llm.common import cut, table

WINDOW, END = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: Word chunks whose ids a worker keeps (about 40 bytes each); it starts afresh beyond that.
KEPT = 1_500_000
#: UTF-8 forms of white space outside ASCII; a text that has one is encoded as a whole.
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class Encoder:
    """Ids of whole texts, by way of their distinct word chunks.

    The vocabulary's splitter never joins characters across the start of a run of white
    space, so a text may be cut there and each distinct piece encoded once.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo = T.Memo(kept)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and offsets of the texts in them."""
        data, offsets = T.buffer_of(texts)
        docs, n = len(offsets) - 1, len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
        raw = data.tobytes()
        space = T._SPACE[data]
        before = np.zeros(n, bool)
        before[1:] = space[:-1]
        begins = np.zeros(n, bool)
        begins[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero((space & ~before) | begins)
        ends = np.append(starts[1:], n)
        keys, at, back = np.unique(T.SpanHash(T._BYTE[data])(starts, ends), return_index=True, return_inverse=True)
        if len(self.memo.keys) > self.memo.most:
            self.memo.clear()
        memo = self.memo
        fresh = np.flatnonzero(memo.find(keys) < 0)
        if len(fresh):
            memo.learn(keys[fresh], self.plain([raw[starts[at[k]] : ends[at[k]]].decode("utf-8") for k in fresh.tolist()]))
        place = memo.find(keys)[back]
        sizes = memo.size[place].astype(np.int64)
        ids = T.gather(memo.flat, memo.first[place], sizes).astype(np.uint32)
        chunk_doc = np.searchsorted(offsets, starts, side="right") - 1
        # an empty text shares its offset with the next one; its chunks belong to the last of them
        bounds = np.concatenate([[0], np.cumsum(np.bincount(chunk_doc, sizes, docs).astype(np.int64))])
        odd = sorted({int(np.searchsorted(offsets, m, side="right")) - 1 for s in _WIDE_SPACE for m in _all(raw, s)})
        if odd:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(docs)]
            for i, own in zip(odd, self.plain([raw[offsets[i] : offsets[i + 1]].decode("utf-8") for i in odd]), strict=True):
                parts[i] = np.array(own, np.uint32)
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder, with what it has learnt in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _all(raw: bytes, what: bytes) -> Iterator[int]:
    at = raw.find(what)
    while at >= 0:
        yield at
        at = raw.find(what, at + 1)


def best_fill(capacity: int, supply: dict[int, int]) -> dict[int, int]:
    """Multiset of lengths, no more of each than supplied, that fills ``capacity`` closest."""
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in supply if x <= capacity and supply[x] > 0), reverse=True):
        steps.append((length, reach))
        left, block = min(supply[length], capacity // length), 1
        while left > 0:  # powers of two: any count up to the supply
            take = min(block, left)
            reach |= (reach << (length * take)) & full
            left, block = left - take, block * 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, before in reversed(steps):
        k = 0
        while not before >> at & 1:  # the fewest of this length that the earlier lengths can complete
            at, k = at - length, k + 1
        if k:
            out[length] = k
    return out


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to count) and how often each is used; together they use up ``counts``."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill(window - longest, rest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // m for k, m in pattern.items())
        out.append((pattern, times))
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """Rows (length, first rank, count in pattern, offset, first window) and the number of windows."""
    used: dict[int, int] = {}
    out, windows = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            many = pattern[length]
            out.append((length, used.get(length, 0), many, offset, windows))
            used[length] = used.get(length, 0) + many * times
            offset += length * many
        windows += times
    return out, windows


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, doc: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, part, nth (and ids)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_for(path)
        seen = np.zeros(window + 1, np.int64)
        for batch in T.slices(batches):
            ids, bounds = encoder.encode(batch.column(1))
            n = batch.num_rows
            # ids with the end id behind each text
            at = bounds + np.arange(n + 1)
            tokens = np.full(int(at[-1]), end, "<u4")
            keep = np.ones(len(tokens), bool)
            keep[at[1:] - 1] = False
            tokens[keep] = ids
            size = np.diff(at)
            many = -(-size // window)
            row = np.repeat(np.arange(n), many)
            start = T.gather(np.arange(int(many.max()) if n else 0), np.zeros(n, np.int64), many) * window
            length = np.minimum(window, size[row] - start)
            raw = tokens.tobytes()
            lo = (at[:-1][row] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * m]) for a, m in zip(lo.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            first = np.searchsorted(sorted_length, sorted_length)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - first + seen[sorted_length]
            seen += np.bincount(length, minlength=window + 1)
            cols = [batch.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(size[row], pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth, pa.int64())]
            if with_ids:
                cols.append(T.ragged(np.concatenate([[0], np.cumsum(length)]), tokens.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * with_ids]
    return src.mapInArrow(T.lean(cut_up), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, doc: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset: pieces() less part and nth, plus sequence_id and offset."""
    cutup = cut(pieces(docs, path, window, end, doc, text, with_ids))
    by_part = cutup.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = cut(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    rows, _ = slots(plan(counts, window))
    rows.sort()
    length, first, many, offset, base = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 40
        keys = length * span + first  # ranks stay under 2**40 for each length
        for b in batches:
            own = np.asarray(b.column("length"))
            rank = np.asarray(b.column("nth")) + np.asarray(b.column("before"))
            k = np.searchsorted(keys, own * span + rank, side="right") - 1
            inner = rank - first[k]
            cols = [b.column(c) for c in out] + [pa.array(base[k] + inner // many[k], pa.int64()), pa.array(offset[k] + inner % many[k] * own, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*out, "sequence_id", "offset"])

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    joined = cutup.join(by_part.select("part", "length", "before"), ["part", "length"])
    return joined.mapInArrow(T.lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long," + " ids array<int>," * with_ids + " sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
