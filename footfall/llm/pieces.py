"""SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary is read from a SentencePiece model file; nothing is trained. Space stands for
the piece mark, one space is put in front of a text, and bytes that no piece covers fall back
to byte pieces, so that decoding gives the text back byte for byte. The file's scores are
merge ranks; by Zipf's law a piece of rank r gets the log-probability -ln(r + 2), and a
byte piece is worse than any other piece.

No piece can span two adjacent bytes that stand together in no piece; cutting a text at all
such places leaves the best segmentation as it is. The distinct stretches of a batch are
grouped by length and advance together: at each place, hashes of all the substrings that end
there probe the sorted keys of the pieces, and the maximum and its backpointer are stored for
the whole group at once. Equal scores go to the longer piece.

Defined results: null and empty texts have no ids and decode to the empty text; extra
columns are ignored; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import textops as T
from footfall.llm.common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Stretches whose ids a worker keeps (about 40 bytes each); it starts afresh beyond that.
KEPT = 1_000_000


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        known: dict[bytes, tuple[int, float]] = {}
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
                continue
            raw = piece.replace(MARK, " ").encode("utf-8")
            self.bytes_of[i] = raw
            known.setdefault(raw, (i, -float(np.log(max(-sp.get_score(i), 0.0) + 2))))
        self.byte_score = -float(np.log(n)) - 10.0
        self.known = known
        raws = list(known)
        self.longest = max(map(len, raws))
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        starts = ends - [len(r) for r in raws]
        keys = T.SpanHash(T._BYTE[data])(starts, ends)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([known[r][0] for r in raws], np.int32)[order]
        self.scores = np.array([known[r][1] for r in raws])[order]
        # adjacent bytes that stand together in some piece
        self.pairs = np.zeros((256, 256), bool)
        inner = np.ones(len(data), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        self.pairs[data[at], data[at + 1]] = True
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.memo = T.Memo(KEPT)

    def viterbi(self, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Best ids and scores of equally long byte rows."""
        n, size = rows.shape
        power, inverse = T._powers(size + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros((size + 1, n), np.uint64)
            np.cumsum((T._BYTE[rows] * power[:size]).T, axis=0, dtype=np.uint64, out=sums[1:])
            best = np.full((size + 1, n), -np.inf)
            best[0] = 0
            step = np.ones((size + 1, n), np.int32)
            used = np.zeros((size + 1, n), np.int32)
            for i in range(1, size + 1):
                best[i] = best[i - 1] + self.byte_score
                used[i] = self.byte_id[rows[:, i - 1]]
                for k in range(1, min(i, self.longest) + 1):
                    keys = T.mix((sums[i] - sums[i - k]) * inverse[i - k] + np.uint64(k))
                    at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                    hit = np.flatnonzero(self.keys[at] == keys)
                    if len(hit):
                        value = best[i - k][hit] + self.scores[at[hit]]
                        better = value >= best[i][hit]
                        hit, value = hit[better], value[better]
                        best[i][hit], step[i][hit], used[i][hit] = value, k, self.ids[at[hit]]
        # read back all rows together
        ids = np.zeros((size, n), np.int32)
        count = np.zeros(n, np.int64)
        here = np.full(n, size)
        live = np.arange(n)
        while len(live):
            ids[size - 1 - count[live], live] = used[here[live], live]
            count[live] += 1
            here[live] -= step[here[live], live]
            live = live[here[live] > 0]
        flat = ids.T
        return [flat[r, size - c :].copy() for r, c in enumerate(count.tolist())], best[size]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, bounds of the texts in them, and the texts' scores."""
        data, offsets = T.buffer_of(texts)
        sizes = np.diff(offsets)
        docs = len(sizes)
        some = np.flatnonzero(sizes)
        if not len(some):
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64), np.zeros(docs)
        data = np.insert(data, offsets[:-1][some], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][some]] = True
        begins[1:] |= ~self.pairs[data[:-1], data[1:]]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        keys, at, back = np.unique(T.SpanHash(T._BYTE[data])(starts, ends), return_index=True, return_inverse=True)
        memo = self.memo
        if len(memo.keys) > memo.most:
            memo.clear()
        fresh = np.flatnonzero(memo.find(keys) < 0)
        found, score = [None] * len(fresh), np.zeros(len(fresh))
        length = (ends - starts)[at[fresh]]
        for size in np.unique(length).tolist():
            group = np.flatnonzero(length == size)
            for lo in range(0, len(group), max(1, (1 << 20) // size)):
                own = group[lo : lo + max(1, (1 << 20) // size)]
                ids, score[own] = self.viterbi(data[starts[at[fresh[own]]][:, None] + np.arange(size)])
                for i, x in zip(own.tolist(), ids, strict=True):
                    found[i] = x
        if len(fresh):
            memo.learn(keys[fresh], found, score)
        place = memo.find(keys)[back]
        many = memo.size[place].astype(np.int64)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, many, docs).astype(np.int64))])
        return T.gather(memo.flat, memo.first[place], many), bounds, np.bincount(doc, memo.worth[place].astype(np.float64), docs)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and their offsets."""
        size = self.size[ids]
        data = T.gather(self.flat, self.first[ids], size)
        offsets = np.concatenate([[0], np.cumsum(size)])[bounds]
        lead = offsets[:-1][np.diff(offsets) > 0]
        return np.delete(data, lead), offsets - np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])


_LOADED: dict[str, Pieces] = {}


def pieces_for(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and score of every text."""
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_for(path)
        for b in T.slices(batches):
            ids, bounds, score = model.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), T.ragged(bounds, ids, pa.int32()), pa.array(score)], names=["doc_id", "ids", "score"])

    return src.mapInArrow(T.lean(own), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, score double")


def decode(encoded: DataFrame, path: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text."""
    src = encoded.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_for(path)
        for b in batches:
            col = b.column("ids")
            at = np.asarray(col.offsets).astype(np.int64)
            data, offsets = model.decode(np.asarray(col.values)[at[0] : at[-1]], at - at[0])
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(T.lean(own), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_ids, ids_crc32 (of little-endian 32-bit ids), score, and whether decoding gave the text back."""
    path = model_path()
    src = table(spark, sf_dir, "documents").select("doc_id", "text")

    def own(batches):
        model = pieces_for(path)
        for b in T.slices(batches):
            data, offsets = T.buffer_of(b.column("text"))
            ids, bounds, score = model.encode(b.column("text"))
            back, at = model.decode(ids, bounds)
            raw, again, packed = data.tobytes(), back.tobytes(), ids.astype("<i4").tobytes()
            crc = [zlib.crc32(packed[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            same = [raw[i:j] == again[k:m] for i, j, k, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(score), pa.array(same, pa.bool_())],
                names=["doc_id", "n_bytes", "n_ids", "ids_crc32", "score", "round_trip"],
            )

    return src.mapInArrow(T.lean(own), "doc_id long, n_bytes long, n_ids long, ids_crc32 long, score double, round_trip boolean")
