"""Language-model scoring with a weighted backoff automaton.

Every token of the training documents and every n-gram of up to three words counts, however rare.
The n-grams are states. A state has arcs for the words it has seen next, weighted by
absolute discounting, and a failure arc to the state without its oldest word, weighted by the
mass left over. The root's weights are the add-one estimates, which every word has.

The automaton is parted by the newest word of a state, so that a state, its arcs and all states its
failure arcs lead to lie in one bucket. With every n-gram a state, the state before a token is named by the
two words before it: each token goes to the bucket of the word before it, where one step
from that state gives its weight, and only sums by document travel back. A bucket
gets its tokens as compressed blocks, so that rows do not grow with n-grams.

The ``WORDS`` commonest words, whose counts every worker knows, are sent by number; the others by
hash, and a token that is such a word passes the bucket of its own count first. N-grams are held
apart by 64-bit hashes of their words. All tokens behind one word lie in one task.

Defined results: null text is empty, and has the end token alone; repeated rows count as often
as they stand; a null id belongs to the training fold; an empty table gives an empty result; with no
training tokens the counts are zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from footfall.llm import textops as T
from footfall.llm.common import cut, doc_crc, table

#: Commonest words that every worker holds with their counts.
WORDS = 1_000_000
DISCOUNT = 0.75
#: Words that one lane of the traversal takes.
LANE = 256
END = np.uint64(0x9D39247E33776D41)
#: Entries that a counting task holds before it passes them on.
HELD = 1 << 20
#: Tokens of a bucket that are put in order at once.
CHUNK = 3 << 19
#: A word's name is its number, if it is common, and else its hash with the first bit set.
TOP, NONE = np.uint64(1 << 63), np.uint64((1 << 64) - 1)
#: Codes of words in a block: numbers, from RARE on places in the block's own list; all bits for no word.
RARE = np.uint32(1 << 31)
_COUNTS = "bucket int, keys binary, counts binary"
_BLOCKS = "turn int, far boolean, n int, listed int, data binary"
_SUMS = "part int, what int, rows binary, sums binary"
#: What sums are of: base scores, known words, scores.
BASE, KNOWN, SCORE = 0, 1, 2


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by bucket, and the bounds of the buckets in it."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _blobs(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    order, at = _by_bucket(keys, buckets)
    keys, counts = keys[order], counts[order].astype(np.int64)
    full = [b for b in range(buckets) if at[b] < at[b + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([counts[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())],
        names=["bucket", "keys", "counts"],
    )


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def with_ends(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end behind each text, and bounds of the texts in them."""
    docs = len(w.first) - 1
    at = w.first + np.arange(docs + 1)
    out = np.full(int(at[-1]), END, np.uint64)
    if len(w.hash):
        out[np.arange(len(w.hash)) + w.doc] = w.hash
    return out, at


def _train(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column("train"))


def word_counts(src: DataFrame, buckets: int) -> DataFrame:
    """Counts of all training tokens as (bucket, keys, counts), one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for b in T.slices(batches):
            k, c = _summed(t := with_ends(T.words(_train(b).column("text")))[0], np.ones(len(t), np.int64))
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k], [c], len(k)
                if held > HELD // 2:
                    yield _blobs(k, c, buckets)
                    keys, counts, held = [], [], 0
        if held:
            yield _blobs(*_summed(np.concatenate(keys), np.concatenate(counts)), buckets)

    def total(t: pa.Table) -> pa.Table:
        k, c = _summed(_flat(t.column("keys"), np.uint64), _flat(t.column("counts"), np.int64))
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary())})

    return src.mapInArrow(T.lean(count), _COUNTS).groupBy("bucket").applyInArrow(T.lean_group(total), _COUNTS)


def _frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with at least ``least`` occurrences; the caller bounds their number."""

    def pick(batches):
        for b in batches:
            for keys, own in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(own, np.int64)
                ok = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([k[ok].tobytes()], pa.binary()), pa.array([c[ok].tobytes()], pa.binary())], names=["keys", "counts"])

    rows = counts.mapInArrow(T.lean(pick), "keys binary, counts binary").collect()
    k, c = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64), np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(k)
    return k[order], c[order]


def _ids(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions in the sorted words; -1 for others."""
    if not len(words):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return T.mix(names & ~TOP) % np.uint64(buckets)


class Common:
    """The commonest words by number, the most frequent first."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts = hashes[order], counts[order]
        place = np.argsort(self.hashes)
        self.sorted, self.number = self.hashes[place], place.astype(np.uint32)

    def names(self, hashes: np.ndarray) -> np.ndarray:
        at = _ids(self.sorted, hashes)
        return np.where(at >= 0, self.number[at].astype(np.uint64), hashes | TOP) if len(self.sorted) else hashes | TOP


def _blocks(bucket: np.ndarray, buckets: int, words: list[np.ndarray], place: np.ndarray, part: np.ndarray, keys: np.ndarray | None = None, counts: np.ndarray | None = None) -> list[tuple]:
    """(bucket, tokens, listed words, data) of tokens by the names u, v, w, row and fold, partition.

    ``counts`` are those of the sorted names ``keys``, which have every rare w.
    """
    v = words[1]
    # equal words side by side take little room
    order = np.argsort(bucket << np.uint64(32) | np.where(v < TOP, v, (v << np.uint64(1) >> np.uint64(33)) + np.uint64(RARE)))
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    got = np.empty((5, len(order)), np.uint32)
    rare = []
    for j in range(3):
        own = words[j][order]
        got[j] = own.astype(np.uint32)
        where = np.flatnonzero((own >= TOP) & (own != NONE))
        rare.append((where, own[where], np.searchsorted(where, at)))
    got[3], got[4] = place[order], part[order]
    out = []
    for k in np.flatnonzero(np.diff(at)):
        lo, n = at[k], int(at[k + 1] - at[k])
        own = [(where[a[k] : a[k + 1]], names[a[k] : a[k + 1]]) for where, names, a in rare]
        listed = np.unique(np.concatenate([names for _, names in own]))
        known = np.zeros(len(listed), np.int64)
        for j, (where, names) in enumerate(own):
            if len(names):
                code = np.searchsorted(listed, names)
                got[j, where] = code.astype(np.uint32) + RARE
                if j == 2:
                    known[code] = counts[np.searchsorted(keys, names)] if counts is not None else 0
        # the bytes of a kind side by side
        raw = np.ascontiguousarray(got[:, lo : lo + n]).view(np.uint8).reshape(5, n, 4).transpose(0, 2, 1).tobytes() + listed.tobytes() + known.tobytes()
        out.append((int(k), n, len(listed), pa.compress(raw, codec="zstd", asbytes=True)))
    return out


def _opened(t: pa.Table) -> Iterator[tuple]:
    """Names u, v, w, row and fold, partition of a block's tokens; its listed names and their counts."""
    for n, r, data in zip(t.column("n").to_pylist(), t.column("listed").to_pylist(), t.column("data"), strict=True):
        raw = np.frombuffer(pa.decompress(data.as_buffer(), 20 * n + 16 * r, codec="zstd"), np.uint8)
        got = np.ascontiguousarray(raw[: 20 * n].reshape(5, 4, n).transpose(0, 2, 1)).view(np.uint32).reshape(5, n)
        listed, known = raw[20 * n : 20 * n + 8 * r].view(np.uint64), raw[20 * n + 8 * r :].view(np.int64)
        names = []
        for j in range(3):
            own = got[j].astype(np.uint64)
            high = np.flatnonzero(got[j] >= RARE)
            code = got[j][high]
            none = code == np.uint32((1 << 32) - 1)
            own[high] = np.where(none, NONE, np.append(listed, NONE)[np.where(none, 0, code - RARE)])
            names.append(own)
        yield (*names, got[3], got[4], listed, known)


class _Dense:
    """Numbers from 0 on, without gaps, of the names added; common names stay in order and come first."""

    def __init__(self, common: int):
        self.met = np.zeros(common + 1, bool)
        self.rare = np.zeros(0, np.uint64)

    def add(self, names: np.ndarray) -> None:
        low = names < TOP
        self.met[names[low].astype(np.int64)] = True
        self.rare = np.union1d(self.rare, names[~low])

    def close(self) -> None:
        self.names = np.concatenate([np.flatnonzero(self.met).astype(np.uint64), self.rare])
        self.at = (np.cumsum(self.met) - 1).astype(np.int32)

    def __call__(self, names: np.ndarray) -> np.ndarray:
        high = np.flatnonzero(names >= TOP)
        out = self.at[np.minimum(names, np.uint64(len(self.at) - 1)).astype(np.int64)].astype(np.int64)
        out[high] = len(self.names) - len(self.rare) + np.searchsorted(self.rare, names[high])
        return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and how often each stands there."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _sums(what: int, part: np.ndarray, row: np.ndarray, value: np.ndarray) -> list[tuple]:
    """(partition, what, rows, sums) of values by row."""
    if not len(row):
        return []
    key, back = np.unique(part << 32 | row, return_inverse=True)
    total = np.bincount(back, value, len(key))
    part, row = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    return [(int(part[a]), what, row[a:b].tobytes(), total[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]


class Automaton:
    """States 0 (root), 1..S: words and pairs that have arcs of their own. ``piece`` makes those of one bucket."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: tuple, triples: tuple, tokens: int, distinct: int):
        size = max(len(words), 1)
        self.words, self.size = words, size
        root = np.log10((counts + 1) / (tokens + distinct + 1)) if len(words) else np.zeros(0)
        p1 = 10.0**root
        (k2, c2), (k3, c3) = pairs, triples
        first, second = (k2 // np.uint64(size)).astype(np.int64), (k2 % np.uint64(size)).astype(np.int64)
        heads = np.unique(first)  # words with arcs
        pair_of = (k3 // np.uint64(size)).astype(np.uint64)
        third = (k3 % np.uint64(size)).astype(np.int64)
        tops = np.unique(pair_of)  # pairs with arcs; each is itself a kept pair
        self.word_state = np.zeros(size, np.int64)
        self.word_state[heads] = 1 + np.arange(len(heads))
        pair_state = 1 + len(heads) + np.arange(len(tops))
        states = 1 + len(heads) + len(tops)
        self.fail, self.back = np.zeros(states, np.int64), np.zeros(states)
        p2 = (c2 - DISCOUNT) / counts[first] if len(k2) else np.zeros(0)
        spare, shadow = np.ones(states), np.ones(states)
        np.add.at(spare, self.word_state[first], -p2)
        np.add.at(shadow, self.word_state[first], -p1[second])
        at = _ids(k2, pair_of)
        p3 = (c3 - DISCOUNT) / c2[at] if len(k3) else np.zeros(0)
        state3 = pair_state[np.searchsorted(tops, pair_of)] if len(k3) else np.zeros(0, np.int64)
        low = self._p2(k2, p2, p1, spare, shadow, (pair_of % np.uint64(size)).astype(np.int64), third) if len(k3) else np.zeros(0)
        np.add.at(spare, state3, -p3)
        np.add.at(shadow, state3, -low)
        self.back[1:] = np.log10(np.maximum(spare[1:], 1e-12) / np.maximum(shadow[1:], 1e-12))
        if len(tops):
            self.fail[pair_state] = self.word_state[(tops % np.uint64(size)).astype(np.int64)]
        # arcs, sorted by state and word; the root's are dense
        state = np.concatenate([self.word_state[first], state3])
        word = np.concatenate([second, third])
        weight = np.log10(np.concatenate([p2, p3])) if len(state) else np.zeros(0)
        last2 = np.concatenate([k2, (k3 % np.uint64(size)) + (pair_of % np.uint64(size)) * np.uint64(size)])
        top = _ids(tops, last2)  # where the last two words are a state
        target = np.where(top >= 0, 1 + len(heads) + top, self.word_state[word]) if len(state) else np.zeros(0, np.int64)
        key = state.astype(np.uint64) * np.uint64(size + 1) + word.astype(np.uint64)
        order = np.argsort(key)
        self.key, self.weight, self.target = key[order], weight[order], target[order]
        self.root = np.append(root, 0.0)  # rare words get theirs elsewhere

    def _p2(self, k2, p2, p1, spare, shadow, v, w):
        own = _ids(k2, v.astype(np.uint64) * np.uint64(self.size) + w.astype(np.uint64))
        state = self.word_state[v]
        lower = np.where(state > 0, np.maximum(spare[state], 1e-12) / np.maximum(shadow[state], 1e-12), 1.0) * p1[w]
        return np.where(own >= 0, p2[np.maximum(own, 0)], lower)

    @classmethod
    def piece(cls, p1: np.ndarray, heads: int, pairs: tuple[np.ndarray, np.ndarray], under: np.ndarray, triples: tuple[np.ndarray, np.ndarray]) -> Automaton:
        """States of ``heads`` words and of pairs that end in the words ``under``, with all that followed them.

        ``p1`` has the root's weights. Pairs and triples are sorted keys, ``state * (len(p1) + 1) + word``, with counts.
        """
        self = cls.__new__(cls)
        size = self.size = len(p1)
        (k2, c2), (k3, c3) = pairs, triples
        first, second, pair, third = (k2 // (size + 1)), k2 % (size + 1), k3 // (size + 1), k3 % (size + 1)
        states = 1 + heads + len(under)
        self.fail = np.concatenate([np.zeros(1 + heads, np.int64), 1 + under])
        often = np.maximum(np.bincount(first, c2, states) + np.bincount(pair, c3, states), 1)
        p2, p3 = (c2 - DISCOUNT) / often[first], (c3 - DISCOUNT) / often[pair]
        spare = DISCOUNT * (np.bincount(first, minlength=states) + np.bincount(pair, minlength=states)) / often
        shadow = 1 - np.bincount(first, p1[second], states) - np.bincount(pair, p2[np.searchsorted(k2, self.fail[pair] * (size + 1) + third)], states)
        # a state without arcs leaves all to the next
        self.back = np.where(spare > 0, np.log10(np.maximum(spare, 1e-300) / np.maximum(shadow, 1e-12)), 0.0)
        self.key, self.weight = np.concatenate([k2, k3]).astype(np.uint64), np.log10(np.concatenate([p2, p3]))
        self.target, self.word_state = np.zeros(len(self.key), np.int64), np.zeros(size, np.int64)
        self.root = np.append(np.log10(p1), 0.0)
        return self

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and the weights of the arcs taken; word -1 is a rare word."""
        weight = np.zeros(len(state))
        out = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        here = state
        while len(open_):
            at_root = (here == 0) | (word[open_] < 0)
            if at_root.any():
                idx = open_[at_root]
                # a rare word fails all the way down
                deep = here[at_root]
                while deep.any():
                    weight[idx] += self.back[deep]
                    deep = self.fail[deep]
                known = word[idx] >= 0
                weight[idx] += self.root[word[idx]]
                out[idx] = np.where(known, self.word_state[word[idx]], 0)
            open_, here = open_[~at_root], here[~at_root]
            if not len(open_):
                break
            key = here.astype(np.uint64) * np.uint64(self.size + 1) + word[open_].astype(np.uint64)
            arc = _ids(self.key, key)
            hit = arc >= 0
            weight[open_[hit]] += self.weight[arc[hit]]
            out[open_[hit]] = self.target[arc[hit]]
            open_, here = open_[~hit], here[~hit]
            weight[open_] += self.back[here]
            here = self.fail[here]
        return out, weight

    def traverse(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weight of every token, texts given by their bounds."""
        out = np.zeros(len(ids))
        if not len(ids):
            return out
        sizes = np.diff(at)
        lanes = -(-sizes // LANE)
        row = np.repeat(np.arange(len(sizes)), lanes)
        begin = at[:-1][row] + T.gather(np.arange(int(lanes.max())), np.zeros(len(lanes), np.int64), lanes) * LANE
        end = np.minimum(begin + LANE, at[1:][row])
        enter = np.maximum(begin - 2, at[:-1][row])
        order = np.argsort(enter - end, kind="stable")  # the longest first
        begin, end, enter = begin[order], end[order], enter[order]
        state = np.zeros(len(begin), np.int64)
        for k in range(int((end - enter).max())):
            live = int(np.searchsorted(enter - end, -k, side="left"))
            pos = enter[:live] + k
            state, weight = self.step(state[:live], ids[pos])
            own = pos >= begin[:live]
            out[pos[own]] = weight[own]
        return out


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", fold=None) -> DataFrame:
    """One row for each document: its id, fold, token counts, base score and model score.

    ``fold`` is a Column that is true for held-out rows (default: crc32 of the id modulo 7 is 2).
    """
    held = (doc_crc(doc) % 7 == 2) if fold is None else fold
    src = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (~F.coalesce(held, F.lit(False))).alias("train"))
    buckets = max(16, 4 * src.rdd.getNumPartitions())
    counts = cut(word_counts(src, buckets))
    levels = np.unique(np.round(1.2 ** np.arange(200)))

    def sums(batches):
        for b in batches:
            for x in b.column("counts").to_pylist():
                own = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([int(own.sum())], pa.int64()), pa.array([[int((own >= k).sum()) for k in levels]], pa.list_(pa.int64()))], names=["v", "n", "over"])

    totals = counts.mapInArrow(T.lean(sums), "v long, n long, over array<long>").collect()
    distinct, tokens = sum(r["v"] for r in totals), sum(r["n"] for r in totals)
    over = np.sum([r["over"] for r in totals], axis=0) if totals else np.zeros(len(levels))
    common = Common(*_frequent(counts, int(levels[np.flatnonzero(over <= WORDS)[0]])))
    total = tokens + distinct + 1
    floor = math.log10(total)
    model = src.sparkSession.sparkContext.broadcast(common)

    def local(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        common, none = model.value, pa.nulls
        held: list[tuple] = []

        def sent():
            """Blocks of the tokens held: to the bucket of the word before, and to the bucket of a rare word itself."""
            w, v, u, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rare = w >= TOP
            for far, own in ((False, ~rare & (v != NONE)), (True, rare)):
                if not own.any():
                    continue
                x = [u[own], v[own], w[own]]
                got = _blocks(_bucket(x[2 if far else 1], buckets), buckets, x, place[own], np.full(len(x[0]), part, np.uint32))
                yield from _rows([(b[0], far, *b[1:], *[None] * 11) for b in got], schema, id_type).to_batches()

        for b in T.slices(batches):
            n = b.num_rows
            t, at = with_ends(T.words(b.column("text")))
            w = common.names(t)
            doc_of = np.repeat(np.arange(n), np.diff(at))
            since = np.arange(len(t)) - at[:-1][doc_of]
            own = w < TOP
            logs = np.log10(common.counts[w[own].astype(np.int64)] + 1.0)
            known = np.bincount(doc_of[own], minlength=n)
            base = np.bincount(doc_of[own], logs, n)
            size = np.diff(at)
            # the first token of a text has the root's weight
            begins = np.zeros(n)
            begins[doc_of[own & (since == 0)]] = logs[since[own] == 0] - floor
            blank = [none(n, pa.bool_()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary()), pa.array(np.full(n, part), pa.int32()), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, buckets + part), pa.int32()), *blank, pa.array(np.arange(row, row + n), pa.int64()), b.column("doc_id").cast(id_type), b.column("train"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base - floor * size), pa.array(begins)],
                names=names,
            )
            u, v = (np.where(since >= k, np.concatenate([np.zeros(k, np.uint64), w])[: len(w)], NONE) for k in (2, 1))
            held.append((w, v, u, ((np.arange(row, row + n) << 1) + np.asarray(b.column("train")))[doc_of].astype(np.uint32)))
            row += n
            if sum(len(x[0]) for x in held) > HELD:
                yield from sent()
        if held:
            yield from sent()

    kind = src.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"{_BLOCKS}, {_SUMS}, row long, doc_id {kind.simpleString()}, train boolean, n_tokens long, n_known long, base double, score double"
    names = [f.split()[0] for f in schema.split(", ")]
    # dealt once: a block goes through a shuffle, where both of its readers find it
    dealt = src.mapInArrow(T.lean(local), schema)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        """Rare words with their counts: blocks for the bucket of the word before, and sums by row."""
        left = left.filter(left.column("far"))
        sums, blocks = [], []
        if left.num_rows:
            k = _flat(right.column("keys"), np.uint64) | TOP if right.num_rows else np.zeros(0, np.uint64)
            c = _flat(right.column("counts"), np.int64) if right.num_rows else np.zeros(0, np.int64)
            order = np.argsort(k)
            k, c = np.append(k[order], NONE), np.append(c[order], 0)
            u, v, w, place, part = (np.concatenate(x) for x in zip(*(b[:5] for b in _opened(left)), strict=True))
            keys = np.unique(w)
            at = _ids(k, keys)
            own = np.where(at >= 0, c[at], 0)
            count = own[np.searchsorted(keys, w)]
            logs, row, first, part = np.log10(count + 1.0), (place >> 1).astype(np.int64), v == NONE, part.astype(np.int64)
            seen = count > 0
            sums = [*_sums(BASE, part[seen], row[seen], logs[seen]), *_sums(KNOWN, part[seen], row[seen], np.ones(int(seen.sum()))), *_sums(SCORE, part[first], row[first], logs[first] - floor)]
            go = ~first
            blocks = _blocks(_bucket(v[go], buckets), buckets, [u[go], v[go], w[go]], place[go], part[go], keys, own)
        return _rows([(b[0], False, *b[1:], *[None] * 4) for b in blocks] + [(buckets + s[0], None, None, None, None, *s) for s in sums], f"{_BLOCKS}, {_SUMS}")

    def weighed(left: pa.Table, right: pa.Table) -> pa.Table:
        """Weights of the tokens of a bucket, summed by row; what has no bucket passes."""
        if (left if left.num_rows else right).column("turn")[0].as_py() >= buckets:
            blank = [pa.nulls(right.num_rows, left.schema.field(c).type) for c in names[9:]]
            right = pa.table([*(right.column(c) for c in names[5:9]), *blank], names=names[5:])
            return pa.concat_tables([left.select(names[5:]).cast(right.schema), right])
        columns = ["n", "listed", "data"]
        t = pa.concat_tables([left.filter(pc.invert(left.column("far"))).select(columns), right.select(columns).cast(left.select(columns).schema)])
        del left, right
        return _rows([(*x, *[None] * 7) for x in _weights(t, model.value, total)], passed, id_type)

    passed = ", ".join(schema.split(", ")[5:])
    far = dealt.groupBy("turn").cogroup(counts.withColumnRenamed("bucket", "turn").groupBy("turn")).applyInArrow(T.lean_group(counted), f"{_BLOCKS}, {_SUMS}")
    rows = dealt.groupBy("turn").cogroup(far.groupBy("turn")).applyInArrow(T.lean_group(weighed), passed)

    def finish(t: pa.Table) -> pa.Table:
        doc = t.filter(pc.is_valid(t.column("row")))
        n = doc.num_rows
        doc = doc.sort_by("row")
        added = []
        for what in (BASE, KNOWN, SCORE):
            own = t.filter(pc.equal(t.column("what"), what))
            added.append(np.bincount(_flat(own.column("rows"), np.int32), _flat(own.column("sums"), np.float64), n) if own.num_rows else np.zeros(n))
        return pa.table(
            {
                "doc_id": doc.column("doc_id"),
                "train": doc.column("train"),
                "n_tokens": doc.column("n_tokens"),
                "n_known": pa.array(np.asarray(doc.column("n_known")) + added[KNOWN].astype(np.int64), pa.int64()),
                "base_score": pa.array(np.asarray(doc.column("base")) + added[BASE]),
                "score": pa.array(np.asarray(doc.column("score")) + added[SCORE]),
            }
        )

    out = rows.groupBy("part").applyInArrow(T.lean_group(finish), f"doc_id {kind.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _weights(t: pa.Table, common: Common, total: int) -> list[tuple]:
    """Sums of the weights of a bucket's tokens, from its blocks."""
    chunks = max(1, -(-pc.sum(t.column("n")).as_py() // CHUNK)) if t.num_rows else 0
    if not chunks:
        return []
    opened = list(_opened(t)) if chunks == 1 else None
    listed, known = (np.concatenate(x) for x in zip(*(x[5:] for x in opened or _opened(t)), strict=True))
    order = np.lexsort((known, listed))  # the last of a name has its count
    listed, known = listed[order], known[order]

    def tokens(k: int | None = None) -> Iterator[tuple]:
        """Blocks of tokens; only those of a chunk, which has all behind the same two words."""
        for x in _opened(t):
            own = slice(None) if k is None else np.flatnonzero(T.mix(x[0]) % np.uint64(chunks) == k)
            yield tuple(y[own] for y in x[:5])

    whole = [tuple(np.concatenate(x) for x in zip(*(x[:5] for x in opened), strict=True))] if opened else None
    del opened
    word, head = _Dense(len(common.hashes)), _Dense(len(common.hashes))
    for _, v, w, _, _ in whole or tokens():
        word.add(w)
        head.add(v)
    word.close()
    head.close()
    size, heads = len(word.names), len(head.names)
    count = np.zeros(size, np.int64)
    low = size - len(word.rare)
    count[:low] = common.counts[word.names[:low].astype(np.int64)]
    count[low:] = known[np.searchsorted(listed, word.rare, side="right") - 1] if len(listed) else 0
    held: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for _, v, w, place, _ in whole or tokens():
        train = place & 1 > 0
        held.append(_runs(np.sort((1 + head(v[train])) * (size + 1) + word(w[train]))))
        if sum(len(x) for x, _ in held[1:]) > max(CHUNK, len(held[0][0])):
            held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
    pairs = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
    out = []
    for k in range(chunks):
        u, v, w, place, part = whole.pop() if whole else (np.concatenate(x) for x in zip(*tokens(k), strict=True))
        under, key = head(v), word(w)
        behind = u != NONE
        # all behind the same two words side by side
        name = T.joined_hash([u, v])
        name[~behind] = 0
        order = np.argsort(name)
        name, under, key, behind, place, part = (x[order] for x in (name, under, key, behind, place, part))
        del u, v, w, order
        new = np.concatenate([[True], name[1:] != name[:-1]]) & behind
        state = np.where(behind, heads + np.cumsum(new), 1 + under)
        tops = under[new]
        order = np.argsort(state * (size + 1) + key)
        state, key, place, part = state[order], key[order], place[order], part[order]
        triples = _runs((state * (size + 1) + key)[(place & 1 > 0) & behind[order]])
        auto = Automaton.piece((count + 1) / total, heads, pairs, tops, triples)
        out += _sums(SCORE, part.astype(np.int64), (place >> 1).astype(np.int64), auto.step(state, key)[1])
    return out


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _rows(rows: list[tuple], schema: str, id_type: pa.DataType | None = None) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[j] for r in rows], id_type if name == "doc_id" else _ARROW[kind]) for j, (name, kind) in enumerate(fields)})


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
