"""Removal of long repeated byte strings by merging shard Burrows-Wheeler transforms.

Every byte that lies in a ``least``-byte string (400) which also starts anywhere else is
removed. Two equal windows of that many bytes have the same least gram hash at the same
place, so windows are keyed by it (their anchor). Consecutive windows with one anchor are a
stretch of at most twice the length. A stretch whose anchor stands nowhere else holds no
repeat and leaves at once; equal stretches are counted, and only distinct ones go on.

The stretches of an anchor meet in one bucket, as sequences of 32-byte symbols aligned
to the anchor. Each shard of a bucket sorts its own suffixes and has its own transform. The
transforms are merged by interleave refinement: the interleave starts in shard order, and each
round follows the transforms one symbol back, by one stable pass, so that after round k suffixes
stand by their first k symbols. No suffix is sorted again. Rounds also part the interleave
into intervals of common prefix k; intervals of two or more at the depth that a window must
contain are the repeated ones. Windows that start in front of such a suffix are then checked
byte for byte by a hash of the whole window.

Defined results: null text is empty; matches never cross documents; repeated rows are
occurrences of each other, so a text of ``least`` bytes or more that stands twice goes
altogether; null ids are kept; extra columns are ignored or carried, whatever their names; an empty table
gives an empty result. A text longer than a slice is hashed on its own, with about 60 bytes of memory for each of its bytes.

Scale: texts are read once for anchors (about one row of 36 bytes per 190 bytes of text). Only
texts that a bitmap of fixed size lets through are shuffled, compressed: once to cut out stretches, once
to remove spans. Buckets have a size in bytes, whatever the input. The stretches
of one anchor are only gathered up to ``HOT_BYTES``; beyond that its windows are counted by hash, by
partial aggregation. Equal texts are worked on once, so a group of copies costs one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import textops as T
from footfall.llm.common import Sieve, cut, stored, table

LEAST = 400
GRAM, SYMBOL = 16, 32
#: Bytes of stretches for each bucket, and most bytes of one anchor's stretches in a bucket.
BUCKET_BYTES, HOT_BYTES = 6 << 20, 12 << 20
CHUNK = 1 << 20
SHARDS = 4


def _window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """doc, first window, number of windows, anchor place, anchor hash and stretch hash of each stretch."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    words = np.ndarray((n - 7,), "<u8", data.tobytes(), 0, (1,))
    with np.errstate(over="ignore"):
        h = T.mix(words[: n - gram + 1] * np.uint64(0x9E3779B97F4A7C15) + T.mix(words[gram - 8 : n - 7]))
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    place = (_window_minimum(key, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del key
    m = len(place)
    size = np.diff(offsets)
    # +1 where a document's windows begin, -1 behind its last one
    change = np.zeros(m + 1, np.int32)
    full = np.flatnonzero(size >= least)
    np.add.at(change, offsets[:-1][full], 1)
    np.add.at(change, np.minimum(offsets[1:][full] - least + 1, m), -1)
    valid = np.cumsum(change[:m]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    counted = np.concatenate([[0], np.cumsum(valid)])
    nxt = np.append(first[1:], m)
    many = counted[nxt] - counted[first]
    doc = np.searchsorted(offsets, first, side="right") - 1
    at = place[first]
    text = T.SpanHash(T._BYTE[data])(first, first + many + least - 1)
    return doc, first - offsets[:-1][doc], many, at - first, h[at], text


def _stretch_rows(docs: DataFrame, least: int) -> DataFrame:
    """Stretches of all texts, one row each."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, most=2 << 20):
            data, offsets = T.buffer_of(b.column("text"))
            doc, start, many, anchor, mh, th = stretches(data, offsets, least)
            yield pa.RecordBatch.from_arrays(
                [b.column("x").take(pa.array(doc, pa.int64())), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(mh.view(np.int64)), pa.array(th.view(np.int64))],
                names=["x", "start", "many", "anchor", "mh", "th"],
            )

    return docs.filter(F.octet_length("text") >= least).select("x", "text").mapInArrow(T.lean(own), "x long, start int, many int, anchor int, mh long, th long")


def _suffix_order(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a shard; every string ends in a symbol of its own, so none are equal."""
    n = len(symbols)
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    _, rank = np.unique(symbols, return_inverse=True)
    # distance to the string's end, beyond which the rank does not matter any more
    end = np.repeat(first[1:], np.diff(first))
    k = 1
    while True:
        idx = np.arange(n) + k
        second = np.where(idx < end, rank[np.minimum(idx, n - 1)] + 1, 0)
        key = rank.astype(np.int64) * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def transform(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard, and the symbol before each suffix (the string's end before its first)."""
    order = _suffix_order(symbols, first)
    before = np.arange(len(symbols)) - 1
    before[first[:-1]] = first[1:] - 1
    return order, symbols[before[order]]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``depth`` symbols, and the intervals of equal ones.

    Returns, place by place, the suffix's number (shards one after the other, each in its own
    order) and the number of its interval.
    """
    sizes = [len(t) for t in transforms]
    symbols = np.concatenate(transforms)
    n = len(symbols)
    _, symbols = np.unique(symbols, return_inverse=True)
    symbols = symbols.astype(np.int32)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    base = np.cumsum(sizes) - sizes
    z = shard.copy()
    interval = np.zeros(n, np.int64)
    follows = np.empty(n, np.int64)  # number of the suffix at each place

    def number(z: np.ndarray) -> None:
        for s in range(len(sizes)):
            here = np.flatnonzero(z == s)
            follows[here] = base[s] + np.arange(len(here))

    number(z)
    for _ in range(depth):
        c = symbols[follows]
        order = np.argsort(c, kind="stable")
        z = z[order]
        c, interval = c[order], interval[order]
        interval = np.concatenate([[0], np.cumsum((c[1:] != c[:-1]) | (interval[1:] != interval[:-1]))])
        number(z)
        if interval[-1] == n - 1:
            break
    return follows, interval


def repeated_windows(texts: list[bytes], anchor: np.ndarray, many: np.ndarray, least: int = LEAST, symbol: int = SYMBOL, shards: int = SHARDS) -> np.ndarray:
    """Which windows of the distinct stretches stand more than once, all stretches' windows in one array."""
    count = len(texts)
    many = many.astype(np.int64)
    out = np.zeros(int(many.sum()), bool)
    if count < 2:
        return out
    size = np.array([len(t) for t in texts], np.int64)
    phase = anchor.astype(np.int64) % symbol
    blocks = np.maximum((size - phase) // symbol, 0)
    # hashes are worked out for about CHUNK bytes of texts at a time
    edges = np.unique(np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), CHUNK)), count))
    chunks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def chunk(lo: int, hi: int) -> tuple[T.SpanHash, np.ndarray]:
        return T.SpanHash(T._BYTE[np.frombuffer(b"".join(texts[lo:hi]), np.uint8)]), np.cumsum(size[lo:hi]) - size[lo:hi]

    hashes = []
    for lo, hi in chunks:
        span, first = chunk(lo, hi)
        many_ = blocks[lo:hi]
        start = np.repeat(first + phase[lo:hi], many_) + T.gather(np.arange(int(many_.max()) + 1), np.zeros(hi - lo, np.int64), many_) * symbol
        hashes.append(span(start, start + symbol))
    own = np.repeat(np.arange(count), blocks)
    _, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    del hashes
    # one end symbol for each string, greater than all others
    length = blocks + 1
    begin = np.cumsum(length) - length
    symbols = np.empty(int(length.sum()), np.int64)
    symbols[np.arange(len(ids)) + own] = ids
    symbols[begin + blocks] = len(ids) + np.arange(count)
    depth = (least - symbol + 1) // symbol
    # shards of whole strings
    shards = max(1, min(shards, count // 2, 250))
    parts = np.linspace(0, count, shards + 1).astype(np.int64)
    edge = np.append(begin, len(symbols))
    orders, transforms = [], []
    for lo, hi in zip(parts[:-1], parts[1:], strict=True):
        a, b = edge[lo], edge[hi]
        order, t = transform(symbols[a:b], edge[lo : hi + 1] - a)
        orders.append(order + a)
        transforms.append(t)
    follows, interval = merge(transforms, depth)
    suffix = np.concatenate(orders)[follows]
    twice = np.zeros(len(symbols), bool)
    twice[suffix] = np.bincount(interval)[interval] > 1
    # the first whole symbol at or after a window's start must begin a repeated interval
    base = np.cumsum(many) - many
    at, keys = [], []
    for lo, hi in chunks:
        span, first = chunk(lo, hi)
        w_own = np.repeat(np.arange(lo, hi), many[lo:hi])
        w = np.arange(len(w_own)) - np.repeat(base[lo:hi] - base[lo], many[lo:hi])
        j = np.maximum(-(-(w - phase[w_own]) // symbol), 0)
        maybe = np.flatnonzero(twice[np.minimum(begin[w_own] + j, len(symbols) - 1)] & (j < blocks[w_own]))
        a = first[w_own[maybe] - lo] + w[maybe]
        at.append(maybe + base[lo])
        keys.append(span(a, a + least))
    maybe, keys = np.concatenate(at), np.concatenate(keys)
    if len(maybe):
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[maybe[order[1:][same]]] = True
        out[maybe[order[:-1][same]]] = True
    return out


def _runs(flags: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window of each run of flagged windows."""
    own = np.repeat(np.arange(len(many)), many)
    w = np.arange(len(own)) - (np.cumsum(many) - many)[own]
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    new = np.concatenate([[True], (on[1:] != on[:-1] + 1) | (own[on[1:]] != own[on[:-1]])])
    end = np.append(np.flatnonzero(new)[1:], len(on)) - 1
    return own[on[new]], w[on[new]], w[on[end]]


def spans(docs: DataFrame, least: int = LEAST, hot_bytes: int = HOT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """x (hash of a text), lo, hi: window runs of each distinct text that stand elsewhere too. ``docs`` has x and text."""
    spark = docs.sparkSession
    rows = stored(_stretch_rows(docs, least))
    distinct = rows.groupBy("mh", "th", "many", "anchor").agg(F.count("*").alias("c"), F.min(F.struct("x", "start")).alias("rep"))
    distinct = distinct.select("mh", "th", "many", "anchor", "c", "rep.x", "rep.start")
    # counted by partial aggregation and joined back, as one anchor may hold a third of all stretches
    kinds = distinct.groupBy(F.col("mh").alias("k")).agg(F.count("*").alias("kinds"), F.sum(F.col("many") + (least - 1)).alias("bytes")).filter("kinds > 1")
    met = stored(distinct.join(kinds, F.col("mh") == F.col("k"), "left").drop("k").filter("kinds IS NOT NULL OR c > 1"))
    meet = met.filter("kinds > 1").withColumn("hot", F.col("bytes") > hot_bytes)
    total = meet.filter("not hot").agg(F.sum(F.col("many") + (least - 1)).alias("b")).first()["b"] or 0
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // bucket_bytes) + 1)
    wanted = meet.groupBy("x").agg(F.collect_list(F.struct("mh", "th", "many", "anchor", "start", "hot")).alias("w"))
    texts = _squeezed(docs.filter(F.octet_length("text") >= least).select(F.col("x").alias("tx"), "text"), "text", Sieve(meet, "x"), "tx")
    both = wanted.join(texts, F.col("x") == F.col("tx")).select("x", "w", "text")

    def pieces(hot: bool):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, expand = None, zstandard.ZstdDecompressor().decompress
            for b in batches:
                for x, w, text in zip(b.column("x").to_pylist(), b.column("w"), b.column("text"), strict=True):
                    if x == before:  # a copy of the text before it
                        continue
                    before = x
                    raw = expand(text.as_py())
                    v = w.values
                    start, many = np.asarray(v.field("start")).astype(np.int64), np.asarray(v.field("many")).astype(np.int64)
                    is_hot = np.asarray(v.field("hot").to_numpy(zero_copy_only=False)).astype(bool)
                    pick = np.flatnonzero(is_hot == hot)
                    if not len(pick):
                        continue
                    mh, th = v.field("mh").take(pa.array(pick)), v.field("th").take(pa.array(pick))
                    start, many = start[pick], many[pick]
                    if not hot:
                        cols = [mh, th, pa.array(many, pa.int32()), v.field("anchor").take(pa.array(pick)), pa.array([raw[s : s + m + least - 1] for s, m in zip(start.tolist(), many.tolist(), strict=True)], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, names=["mh", "th", "many", "anchor", "body"])
                    else:
                        span = T.SpanHash(T._BYTE[np.frombuffer(raw, np.uint8)])
                        own_ = np.repeat(np.arange(len(pick)), many)
                        w_ = np.arange(len(own_)) - (np.cumsum(many) - many)[own_]
                        a = start[own_] + w_
                        yield pa.RecordBatch.from_arrays([mh.take(pa.array(own_)), th.take(pa.array(own_)), pa.array(w_, pa.int32()), pa.array(span(a, a + least).view(np.int64))], names=["mh", "th", "at", "wh"])

        return own

    cutout = both.mapInArrow(T.lean(pieces(False)), "mh long, th long, many int, anchor int, body binary").withColumn("bucket", F.pmod(F.xxhash64("mh"), F.lit(buckets)).cast("int"))

    def bucket(t: pa.Table) -> pa.Table:
        mh, th = np.asarray(t.column("mh")), np.asarray(t.column("th"))
        order = np.lexsort((th, mh))
        keep = order[np.concatenate([[True], (mh[order[1:]] != mh[order[:-1]]) | (th[order[1:]] != th[order[:-1]])])] if len(order) else order
        t = t.take(pa.array(keep))
        many = np.asarray(t.column("many")).astype(np.int64)
        row, lo, hi = _runs(repeated_windows(t.column("body").to_pylist(), np.asarray(t.column("anchor")), many, least), many)
        return pa.table({"mh": t.column("mh").take(pa.array(row)), "th": t.column("th").take(pa.array(row)), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})

    decided = cutout.groupBy("bucket").applyInArrow(T.lean_group(bucket), "mh long, th long, lo int, hi int")
    if meet.filter("hot").limit(1).count():
        windows = both.mapInArrow(T.lean(pieces(True)), "mh long, th long, at int, wh long").groupBy("mh", "th", "at", "wh").agg(F.lit(1).alias("one"))
        twice = windows.groupBy("wh").agg(F.count("*").alias("n")).filter("n > 1").select("wh")
        decided = decided.unionByName(windows.join(twice, "wh").select("mh", "th", F.col("at").alias("lo"), F.col("at").alias("hi")))
    # a stretch that stands twice is repeated as a whole
    whole = met.filter("c > 1").select("mh", "th", F.lit(0).alias("lo"), (F.col("many") - 1).alias("hi"))
    verdict = stored(decided.join(whole.select("mh", "th"), ["mh", "th"], "left_anti").select("mh", "th", "lo", "hi").unionByName(whole))
    places = Sieve(verdict, "th").sift(rows.select("x", "start", "mh", "th"), "th")
    return places.join(verdict, ["mh", "th"]).select("x", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).distinct()


def _squeezed(rows: DataFrame, text: str, sieve: Sieve, key: str) -> DataFrame:
    """The rows that the sieve lets through, with the text as compressed bytes, for a shuffle."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in T.slices((sieve.keep(x, key) for x in batches), text):
            at = b.schema.get_field_index(text)
            data, offsets = T.buffer_of(b.column(at))
            raw = data.tobytes()
            small = pa.array([squeeze(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([small if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(T.lean(own), kinds)


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, carry: list[str] | None = None, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Every row's id, its bytes without repeats, and the removed spans (begin and end in bytes); ``carry`` keeps columns.

    Columns: _id, _bytes (of the input), _rest (the bytes left), _clean (these as text, less
    characters that a removed span cut in two), _begins, _ends.
    """
    names = [f"_carry{k}" for k in range(len(carry or []))]
    named = [F.col(c).alias(n) for c, n in zip(carry or [], names, strict=True)]
    body = docs.select(F.col(doc).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_x"), *named)
    found = spans(body.select(F.col("_x").alias("x"), F.col("_text").alias("text")), least, hot_bytes)
    by_text = cut(found.groupBy(F.col("x").alias("_sx")).agg(F.collect_list("lo").alias("_lo"), F.collect_list("hi").alias("_hi")))
    sieve = Sieve(by_text, "_sx")
    hit = _squeezed(body, "_text", sieve, "_x").join(by_text, F.col("_x") == F.col("_sx"), "left")
    rest = body.withColumns({"_lo": F.lit(None).cast("array<int>"), "_hi": F.lit(None).cast("array<int>")})

    def cutter(squeezed: bool):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            expand = zstandard.ZstdDecompressor().decompress
            for b in T.slices(batches if squeezed else (sieve.keep(x, "_x", through=False) for x in batches), "_text"):
                rest, begins, ends, size = [], [], [], []
                data, offsets = T.buffer_of(b.column(b.schema.get_field_index("_text")))
                raw = data.tobytes()
                for i, (lo, hi) in enumerate(zip(b.column("_lo").to_pylist(), b.column("_hi").to_pylist(), strict=True)):
                    body = raw[offsets[i] : offsets[i + 1]]
                    body = expand(body) if squeezed else body
                    size.append(len(body))
                    left, a, z = _without(body, lo or (), hi or (), least)
                    rest.append(left)
                    begins.append(a)
                    ends.append(z)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id"), pa.array(size, pa.int64()), pa.array(rest, pa.binary()), pa.array([r.decode("utf-8", "ignore") for r in rest], pa.string()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), *[b.column(c) for c in names]],
                    names=["_id", "_bytes", "_rest", "_clean", "_begins", "_ends", *names],
                )

        return own

    kinds = {f.name: f.dataType.simpleString() for f in body.schema.fields}
    schema = f"_id {kinds['_id']}, _bytes long, _rest binary, _clean string, _begins array<long>, _ends array<long>" + "".join(f", `{c}` {kinds[c]}" for c in names)
    out = hit.drop("_sx").mapInArrow(T.lean(cutter(True)), schema).unionByName(rest.mapInArrow(T.lean(cutter(False)), schema))
    return out.toDF(*[c for c in out.columns if c not in names], *(carry or []))


def _without(body: bytes, lo, hi, least: int) -> tuple[bytes, list[int], list[int]]:
    """The bytes outside all window runs lo to hi, and the removed spans."""
    if not len(lo):
        return body, [], []
    lo, hi = np.array(lo, np.int64), np.array(hi, np.int64) + least
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    a, z = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
    edges = [0, *np.stack([a, z], 1).ravel().tolist(), len(body)]
    return b"".join(body[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)), a.tolist(), z.tolist()


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), (F.col("_bytes") - F.octet_length("_rest")).cast("long").alias("n_removed"), F.size("_begins").cast("long").alias("n_spans"), F.sha2("_rest", 256).alias("kept_sha256"))


#: All windows of every text by their hash (texts in hexadecimal, two digits a byte), and the bytes between removed runs.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 2 * {LEAST})) AS h FROM (SELECT r, x, unnest(range(0, n - {LEAST} + 1)) AS i FROM d WHERE n >= {LEAST})),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
f AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {LEAST}, true)::INT AS new FROM t),
s AS (SELECT r, min(i) AS a, max(i) + {LEAST} AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM f) GROUP BY r, run),
b AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM b JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(from_hex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
