"""Convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of hashed vectors of the word and of its first bytes, so that
inflected forms share what they have in common. Filters of several widths run over the
sequence, the largest response of each is kept, and a logistic layer scores them. Every
labelled row outside the held-out fold trains, with its whole text: rows are dealt to groups
of about ``ROWS`` by the hash of their id, each group trains a copy of the net by Adagrad, and
the copies are averaged in the executors, a word's vector over the groups that met it. A second round
starts from the average. The thresholds count the outputs of all those rows. Scoring is one
pass over all texts in numpy, with nothing shuffled.

Thresholds are calibrated by language. The language is guessed from the letters of the text
itself, never read from a column; each guess has its own threshold on the raw output, and
the score is shifted so that 0.7 stands at that threshold.

Defined results: null and empty texts get the score of a text without words; a row without
label, or with a null label, trains nothing; with no labelled rows every score is the prior;
extra columns are kept out; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import textops as T
from footfall.llm.common import cut, doc_crc, stored, table

#: Rows and characters of a group that trains on its own, and slices in which embeddings are summed.
ROWS, CHARS, SLICES = 4000, 8_000_000, 16
#: Hash buckets of the embedding, its size, filter widths, filters of each width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 6
PREFIXES = (4, 5, 6)
EPOCHS, RATE, BATCH = 6, 0.2, 32
#: Labels that are sent to every executor; more of them are joined by a shuffle.
BROADCAST = 2_000_000
#: Outputs are counted in steps of this size for the thresholds.
STEP = 1 / 4096
CUT = 0.7
LANGUAGES = 4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every word (words by features; the last bucket is padding), text bounds, guessed language."""
    w = T.words(texts)
    n = len(w.start)
    span = T.SpanHash(T._BYTE[w.data])
    solid = np.isin(w.data, np.frombuffer(b".,;:!?\"'()[]*#$%&|<>", np.uint8))
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):  # punctuation around the word
        if n:
            end -= (end - start > 1) & solid[end - 1]
            start += (end - start > 1) & solid[start]
    out = np.full((n, 1 + len(PREFIXES)), BUCKETS, np.int32)
    if n:
        out[:, 0] = span(start, end) % np.uint64(BUCKETS)
        for j, k in enumerate(PREFIXES):
            long = end - start > k
            out[long, 1 + j] = T.mix(span(start[long], start[long] + k) + np.uint64(k)) % np.uint64(BUCKETS)
    return out, w.first, _language(w.data, w.offsets)


def _language(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 to 3 by the letters beyond ASCII: few, umlauts and sharp s, acute and tilde, grave and circumflex."""
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    kind = np.zeros(256, np.int8)
    kind[[0xA4, 0xB6, 0xBC, 0x9F, 0x84, 0x96, 0x9C]] = 1
    kind[[0xB1, 0xB3, 0xAD, 0xA1, 0xBA, 0x91, 0x93]] = 2
    kind[[0xA8, 0xAA, 0xA0, 0xA7, 0xB4, 0xAE, 0xB9, 0xA9]] = 3
    own = np.where(lead, kind[data], 0) if len(data) else np.zeros(0, np.int8)
    count = np.stack([np.concatenate([[0], np.cumsum(own == k)])[offsets] for k in range(1, LANGUAGES)])
    count = np.diff(count, axis=1)
    best = count.argmax(axis=0) + 1
    return np.where(count.max(axis=0) * 100 > np.diff(offsets), best, 0)


class Net:
    """Embedding, filters and output weights; forward over many texts at once, backward through the maxima."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS + 1, SIZE), np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(k * SIZE), (k * SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS]
        self.out = np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32)
        self.prior = np.float32(-2.0)
        self.shift = np.zeros(LANGUAGES, np.float64)
        self.embed[:BUCKETS] = rng.normal(0, 0.01, (BUCKETS, SIZE))
        self.trained = np.zeros(BUCKETS + 1, bool)

    def copy(self) -> Net:
        return copy.deepcopy(self)

    def pooled(self, words: np.ndarray, first: np.ndarray, where: bool = False):
        """Largest response of each filter in each text (and the places of the maxima)."""
        vec = self.embed[words[:, 0]]
        for j in range(1, words.shape[1]):
            vec += self.embed[words[:, j]]
        n, docs = len(vec), len(first) - 1
        full = np.flatnonzero(np.diff(first) > 0)
        doc_end = np.repeat(first[1:], np.diff(first))
        out = np.zeros((docs, FILTERS * len(WIDTHS)), np.float32)
        at = np.zeros((docs, FILTERS * len(WIDTHS)), np.int64) if where else None
        for i, k in enumerate(WIDTHS):
            z = np.repeat(self.bias[i][None], n, 0)
            for t in range(k):  # a window that runs over the text's end sees zeros there
                z[: n - t] += (vec[t:] * (np.arange(n - t) + t < doc_end[: n - t])[:, None] if t else vec) @ self.filters[i][t * SIZE : (t + 1) * SIZE]
            np.maximum(z, 0, out=z)
            if len(full):
                top = np.maximum.reduceat(z, first[full], axis=0)
                out[full, i * FILTERS : (i + 1) * FILTERS] = top
                if where:
                    for j in range(FILTERS):
                        hit = np.flatnonzero(z[:, j] == np.repeat(top[:, j], np.diff(first)[full]))
                        owner = np.searchsorted(first, hit, side="right") - 1
                        got, idx = np.unique(owner, return_index=True)
                        at[got, i * FILTERS + j] = hit[idx]
        return (out, at, vec) if where else out

    def raw(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(words, first).astype(np.float64) @ self.out + self.prior

    def train(self, words: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        squares = [np.full_like(x, 1e-3) for x in (self.embed, *self.filters, *self.bias, self.out)]
        weight = np.where(label > 0, 1.0, max(label.mean(), 0.05) / max(1 - label.mean(), 0.05))
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for lo in range(0, len(order), BATCH):
                pick = np.sort(order[lo : lo + BATCH])
                size = np.diff(first)[pick]
                own = T.gather(np.arange(len(words)), first[pick], size)
                bounds = np.concatenate([[0], np.cumsum(size)])
                h, at, vec = self.pooled(words[own], bounds, True)
                p = 1 / (1 + np.exp(-(h @ self.out + self.prior)))
                err = ((p - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
                back = err[:, None] * self.out[None] * (h > 0)
                self._move(self.out, squares[-1], h.T @ err + 1e-4 * self.out)
                self.prior -= np.float32(RATE * err.sum())
                grad = np.zeros_like(vec)
                for i, k in enumerate(WIDTHS):
                    b = back[:, i * FILTERS : (i + 1) * FILTERS]
                    pos = at[:, i * FILTERS : (i + 1) * FILTERS]
                    df = np.zeros_like(self.filters[i])
                    for t in range(k):
                        p_t = pos + t
                        ok = (p_t < bounds[1:, None]) & (size > 0)[:, None]
                        safe = np.where(ok, p_t, 0)
                        g = b * ok
                        rows = slice(t * SIZE, (t + 1) * SIZE)
                        if len(vec):
                            df[rows] = np.einsum("djs,dj->sj", vec[safe], g)
                            np.add.at(grad, safe.ravel(), (g[:, :, None] * self.filters[i][rows].T[None]).reshape(-1, SIZE))
                    self._move(self.filters[i], squares[1 + i], df + 1e-5 * self.filters[i])
                    self._move(self.bias[i], squares[1 + len(WIDTHS) + i], b.sum(0))
                hot = np.flatnonzero(np.abs(grad).sum(1) > 0)
                buckets = words[own][hot]
                flat = buckets.ravel()
                each = np.repeat(grad[hot], buckets.shape[1], 0)
                keys, inv = np.unique(flat, return_inverse=True)
                total = np.zeros((len(keys), SIZE), np.float32)
                np.add.at(total, inv, each)
                squares[0][keys] += total**2
                self.embed[keys] -= RATE * total / np.sqrt(squares[0][keys])
                self.embed[BUCKETS] = 0
        seen = np.zeros(BUCKETS + 1, bool)
        seen[words.ravel()] = True
        self.embed[~seen] = 0  # a word never met says nothing

    @staticmethod
    def _move(value: np.ndarray, squares: np.ndarray, grad: np.ndarray) -> None:
        squares += grad**2
        value -= RATE * grad / np.sqrt(squares)

    def calibrate(self, raw: np.ndarray, label: np.ndarray, language: np.ndarray, count: np.ndarray) -> None:
        """The threshold of each language: the middle of the gap that gets most rows right; ``count`` rows have each output."""
        everyone = _threshold(raw, label, count)
        for k in range(LANGUAGES):
            own = language == k
            enough = min(count[own & (label > 0)].sum(), count[own & (label == 0)].sum()) >= 10
            self.shift[k] = _threshold(raw[own], label[own], count[own]) if enough else everyone

    def scores(self, words: np.ndarray, first: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = self.raw(words, first) - self.shift[language] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _threshold(raw: np.ndarray, label: np.ndarray, count: np.ndarray) -> float:
    if not len(raw) or label.min() == label.max():
        return float(np.log(CUT / (1 - CUT)))
    z, at = np.unique(raw, return_inverse=True)
    bad, good = (np.bincount(at, count * own, len(z)) for own in (label > 0, label == 0))
    wrong = np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([[0], np.cumsum(good[::-1])])[::-1]
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best].mean())


def _sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, positive: int | None, negative: int | None) -> DataFrame:
    """Labelled rows outside the held-out fold: s_doc, s_text, y."""
    known = labels.select(F.col(doc).alias("l_doc"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("l_doc").isNotNull() & (doc_crc("l_doc") % 3 != 1))
    known = known.groupBy("l_doc").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    if positive is not None or negative is not None:
        many = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        rates = [1.0 if bound is None else bound / max(many.get(k, 0), 1) for k, bound in ((1, positive), (0, negative))]
        known = known.filter(F.pmod(F.xxhash64("l_doc", F.lit(5)), F.lit(1 << 30)) < F.when(F.col("y") > 0, F.lit(rates[0])).otherwise(F.lit(rates[1])) * F.lit(1 << 30))
    known = cut(known)
    # few labels spare the other texts a shuffle
    known = F.broadcast(known) if known.count() <= BROADCAST else known
    rows = docs.select(F.col(doc).alias("s_doc"), F.col(text).alias("s_text")).join(known, F.col("s_doc") == F.col("l_doc"))
    return rows.groupBy("s_doc").agg(F.min_by(F.struct("s_text", "y"), F.xxhash64("s_text")).alias("r")).select("s_doc", "r.s_text", "r.y")


def _sent(net: Net, words: np.ndarray | None, n: int) -> pa.Table:
    """What a group of ``n`` rows sends of its copy: bits of the buckets it met and their vectors; the rest in a last slice."""
    per, mets, values = BUCKETS // SLICES, [], []
    if n:
        met = np.zeros(BUCKETS + 1, bool)
        met[words.ravel()] = True
        for k in range(SLICES):
            own = met[k * per : (k + 1) * per]
            mets.append(np.packbits(own).tobytes())
            values.append(net.embed[k * per : (k + 1) * per][own].tobytes())
        mets.append(b"")
        values.append(np.concatenate([x.ravel() for x in (*net.filters, *net.bias, net.out)] + [[net.prior]]).astype(np.float32).tobytes())
    return pa.table({"slice": pa.array(range(len(mets)), pa.int32()), "met": pa.array(mets, pa.binary()), "value": pa.array(values, pa.binary()), "n": pa.array([n] * len(mets), pa.int64())})


def _total(t: pa.Table) -> pa.Table:
    """Rows that met each bucket of a slice, and the sums of the vectors weighted by them, in double precision."""
    own = t.column("slice")[0].as_py() < SLICES
    met, value = (np.zeros(BUCKETS // SLICES), np.zeros((BUCKETS // SLICES, SIZE))) if own else (np.zeros(1), 0.0)
    for bits, x, n in zip(*(t.column(c).to_pylist() for c in ("met", "value", "n")), strict=True):
        x = np.frombuffer(x, np.float32).astype(np.float64) * n
        if own:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
            met[at] += n
            value[at] += x.reshape(-1, SIZE)
        else:
            met, value = met + n, value + x
    return pa.table({"slice": t.column("slice")[:1], "met": pa.array([met.tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})


def _round(sample: DataFrame, net: Net, epochs: int, seed: int) -> Net | None:
    """The average of copies of ``net`` that each group of rows has trained."""
    model = sample.sparkSession.sparkContext.broadcast(net)
    per = BUCKETS // SLICES

    def own(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        y = np.asarray(t.column("y")).astype(np.float64)
        if y.min() == y.max():
            return _sent(model.value, None, 0)
        # the hashes of a slice take many times its bytes, those of all its words a few
        parts = [features(b.column("s_text"))[:2] for b in T.slices(iter(t.to_batches()), "s_text")]
        del t
        words, first = np.concatenate([w for w, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
        del parts
        T.release()
        net = model.value.copy()
        net.train(words, first, y, epochs, seed)
        return _sent(net, words, len(y))

    kind = "slice int, met binary, value binary"
    rows = sample.groupBy("part").applyInArrow(T.lean_group(own), f"{kind}, n long").groupBy("slice").applyInArrow(T.lean_group(_total), kind).collect()
    if not rows:
        return None
    out = net.copy()
    out.embed[:] = 0  # a word never met says nothing
    for r in rows:
        met, value = np.frombuffer(r["met"], np.float64), np.frombuffer(r["value"], np.float64)
        if r["slice"] < SLICES:
            out.embed[r["slice"] * per : (r["slice"] + 1) * per] = value.reshape(per, SIZE) / np.maximum(met, 1)[:, None]
        else:
            value, at = value / met[0], 0
            for x in (*out.filters, *out.bias, out.out):
                x[...] = value[at : at + x.size].reshape(x.shape)
                at += x.size
            out.prior = np.float32(value[at])
    return out


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", positive: int | None = None, negative: int | None = None) -> Net:
    """Train on the labelled rows outside the held-out fold (crc32 of the id modulo 3 is 1).

    An id with several labels is toxic if any of them says so; of documents that share an id the one with the least
    text hash is taken. All rows train and all are counted for the thresholds; only a caller that sets ``positive`` or
    ``negative`` has about so many of a label drawn.
    """
    sample = stored(_sample(docs, labels, doc, text, label, positive, negative).select(F.col("s_doc").cast("string").alias("k"), "s_text", "y"))
    size = sample.agg(F.count("*").alias("n"), F.sum(F.char_length("s_text")).alias("c"), F.countDistinct("y").alias("kinds")).first()
    net = Net()
    if not size["n"]:
        return net
    parts = max(-(-size["n"] // ROWS), -(-(size["c"] or 0) // CHARS), 1)
    dealt = sample.withColumn("part", F.pmod(F.xxhash64("k", F.lit(9)), F.lit(parts)).cast("int"))
    if size["kinds"] > 1:
        for k, epochs in enumerate([EPOCHS] if parts == 1 else [EPOCHS // 2, EPOCHS - EPOCHS // 2]):
            net = _round(dealt, net, epochs, 11 + k) or net
    model = docs.sparkSession.sparkContext.broadcast(net)

    def outputs(batches):
        for b in T.slices(batches, "s_text"):
            words, first, language = features(b.column("s_text"))
            steps = np.round(model.value.raw(words, first) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(language, pa.int32()), b.column("y")], names=["step", "language", "y"])

    got = sample.select("s_text", "y").mapInArrow(T.lean(outputs), "step long, language int, y int").groupBy("step", "language", "y").agg(F.count("*").alias("n")).toArrow()
    raw, y, language, n = (np.asarray(got.column(c)) for c in ("step", "y", "language", "n"))
    net.calibrate(raw * STEP, y, language, n)
    return net


def score(docs: DataFrame, net: Net, doc: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and predicted for every row; ``keep`` names columns to carry along."""
    names = [f"_carry{k}" for k in range(len(keep))] if keep is not None else ["doc_id", "text"]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep if keep is not None else [doc, text], names, strict=True)])
    body = "text" if keep is None else names[keep.index(text)]
    model = docs.sparkSession.sparkContext.broadcast(net)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in T.slices(batches, body):
            words, first, language = features(b.column(body))
            s = net.scores(words, first, language)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*names, "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + ", _score double"
    out = src.mapInArrow(T.lean(own), schema)
    return out if keep is None else out.toDF(*keep, "_score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(doc_crc() % 3 == 1, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
