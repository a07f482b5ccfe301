"""Exact Jaccard self-join on word n-grams, answered by groups.

Sets link when 100 * |A & B| >= 75 * |A | B|. Equal sets are one class, represented by the
least id. Counting shingles by hash bucket tells for each class which of its shingles any
other class has. A class with fewer than three quarters of its set shared cannot link and
leaves here, which is nearly every class of a corpus. The others enter an index under
their rarest shingles only: sets of size n that link share one of the first
n - ceil(0.75 n) + 1 in any common order, and unshared shingles count as rarest.

The index lists are read with set relations instead of pair by pair. A list's entries lie in
blocks of similar size; only blocks in reach of a set's size are opened, and an entry is
passed over if too few tokens lie ahead of its position. A pivot of each list is compared with
the list's members first. Members that link to the pivot have its answers: they are in one
group, and no pair among them is compared any more (answer-level skipping). Later rounds
draw other pivots, from each list's largest group, for the members outside it; in the end the pairs that still cross groups are
compared one by one, less those that the distances to a common pivot rule out (the
Jaccard distance obeys the triangle inequality). So every pair that could join two groups is
either compared or ruled out, and groups are exact.

Defined results: null text or text without words is an empty set, linked with nothing;
a text of fewer than five words is one shingle; repeated rows get a row each; extra columns
are ignored; an empty table gives an empty result. Shingles are compared by 48 bits of
a 64-bit hash.

Scale: per shingle, 8 bytes cross the network once. Shingles that many classes hold are found slice by
slice and bypass the counting buckets. No list is gathered for a task and no
group expanded; links and groups stay tables. Heavy shingles have long lists only if many
classes hold little else, and then one round of pivots joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm import textops as T
from footfall.llm.common import WORD, cut, table

WIDTH, PERCENT = 5, 75
#: Most rounds of pivots, and pivots that a set is compared with in one round.
ROUNDS, PIVOTS = 14, 2
#: The rounds end early once no more pairs than this, for each index entry, cross groups, or
#: once a round adds no more than this share of the links.
PAIRS_EACH, LEAST_GAIN = 1, 0.02
#: Shingles that one counting bucket should hold.
BUCKET_ROWS = 1_000_000
#: Classes of one slice that make a shingle hot there, and the share of all shingles from which on it
#: is set apart (no more than the inverse of it can reach that share, so they may be broadcast).
HOT_CLASSES, HOT_SHARE = 8, 1e-6
_LOW48 = np.uint64((1 << 48) - 1)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and bounds."""
    w = T.words(texts)
    doc, key = T.shingles(w, width)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    if len(key):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(len(w.first)))


def _signs(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, of all its members."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros(len(at) - 1, np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            a = np.add.reduceat(T.mix(key), at[full])
            b = np.bitwise_xor.reduceat(T.mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[full])
            out[full] = T.joined_hash([a, b, np.diff(at)[full].astype(np.uint64)])
    return out


def _distinct(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs and sizes of a slice's sets, and the first row of each different set that is not empty."""
    sign, size = _signs(key, at), np.diff(at)
    one = np.sort(np.unique(sign, return_index=True)[1])
    return sign, size, one[size[one] > 0]


def classes(docs: DataFrame, doc: str, text: str, width: int, hot: int = HOT_CLASSES) -> DataFrame:
    """doc_id, text_key, sid (of equal sets), n (size of the set); and rows (token, c) for shingles that are hot in a slice."""
    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_key"), F.col(text).alias("text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            key, at = _sets(b.column("text"), width)
            sign, size, one = _distinct(key, at)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sign.view(np.int64)), pa.array(size, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            token, count = np.unique(T.gather(key, at[one], size[one]) & _LOW48, return_counts=True)
            token, count = token[count >= hot], count[count >= hot]
            m = len(token)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 4, pa.array(token.view(np.int64)), pa.array(count, pa.int64())], names=names)

    names = ["doc_id", "text_key", "sid", "n", "token", "c"]
    return src.mapInArrow(T.lean(own), "doc_id long, text_key long, sid long, n long, token long, c long")


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared(docs: DataFrame, text: str, width: int, buckets: int, parts: int, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    """sid, n, tokens (those that other classes have, the rarest first) of the classes that can link.

    ``hot`` are sorted shingles known to be shared widely: they rank last, and their entries go straight to
    their classes, so that no bucket has to hold a list of a third of all classes.
    """
    src = docs.select(F.col(text).alias("text"))
    apart = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if hot is None else hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            key, at = _sets(b.column("text"), width)
            sign, size, one = _distinct(key, at)  # equal sets of a slice once
            if not len(one):
                continue
            token = T.gather(key, at[one], size[one]) & _LOW48
            own = np.repeat(np.arange(len(one)), size[one])
            bucket = (token % np.uint64(buckets)).astype(np.int32)
            heavy = apart.value
            if len(heavy):
                known = heavy[np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)] == token
                bucket = np.where(known, buckets + (sign[one[own]] % np.uint64(parts)).astype(np.int32), bucket)
            order = np.argsort(bucket, kind="stable")
            token, own, bucket = token[order], own[order], bucket[order]
            bound = np.searchsorted(bucket, np.arange(buckets + parts + 1))
            rows: dict[str, list] = {"bucket": [], "sids": [], "ns": [], "own": [], "low": [], "high": []}
            low, high = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32), (token >> np.uint64(32)).astype(np.uint16)
            for k in np.unique(bucket).tolist():
                cut_ = slice(bound[k], bound[k + 1])
                who, idx = np.unique(own[cut_], return_inverse=True)
                rows["bucket"].append(k)
                rows["sids"].append(sign[one[who]].tobytes())
                rows["ns"].append(size[one[who]].astype(np.uint32).tobytes())
                rows["own"].append(idx.astype(np.uint16 if len(who) < 65536 else np.uint32).tobytes())
                rows["low"].append(low[cut_].tobytes())
                rows["high"].append(high[cut_].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in names[1:]]], names=names)

    names = ["bucket", "sids", "ns", "own", "low", "high"]

    def count(t: pa.Table) -> pa.Table:
        token, sid, size = [], [], []
        for sids, ns, own, low, high in zip(*(t.column(c).to_pylist() for c in names[1:]), strict=True):
            s, n = np.frombuffer(sids, np.uint64), np.frombuffer(ns, np.uint32)
            lo = np.frombuffer(low, np.uint32)
            o = np.frombuffer(own, np.uint16 if len(s) < 65536 else np.uint32)
            token.append(lo.astype(np.uint64) | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)))
            sid.append(s[o])
            size.append(n[o])
        token, sid, size = np.concatenate(token), np.concatenate(sid), np.concatenate(size)
        heavy = t.column("bucket")[0].as_py() >= buckets
        order = np.argsort(token, kind="stable")
        token, sid, size = token[order], sid[order], size[order]
        # tokens that stand once go first, as they are most
        new = np.concatenate([[True], token[1:] != token[:-1]])
        group = np.cumsum(new) - 1
        some = (np.bincount(group)[group] > 1) | heavy
        token, sid, size, group = token[some], sid[some], size[some], group[some]
        order = np.lexsort((sid, group))
        token, sid, size, group = token[order], sid[order], size[order], group[order]
        if len(token):
            # the same class from several slices counts once; two tokens of one class may agree in 48 bits
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (sid[1:] != sid[:-1])])
            token, sid, size, group = token[fresh], sid[fresh], size[fresh], group[fresh]
            df = np.bincount(group)[group]
            keep = (df > 1) | heavy
            token, sid, size, df = token[keep], sid[keep], size[keep], df[keep]
        else:
            df = np.zeros(0, np.int64)
        rank = np.minimum(np.floor(np.log2(np.maximum(df, 1)) * 4), 254).astype(np.uint8)
        rank = np.full_like(rank, 255) if heavy else rank
        part = (sid % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        bound = np.searchsorted(part[order], np.arange(parts + 1))
        rows: dict[str, list] = {"part": [], "sids": [], "ns": [], "own": [], "tokens": [], "ranks": []}
        for k in np.unique(part).tolist():
            pick = order[bound[k] : bound[k + 1]]
            who, first, idx = np.unique(sid[pick], return_index=True, return_inverse=True)
            rows["part"].append(k)
            rows["sids"].append(who.tobytes())
            rows["ns"].append(size[pick][first].astype(np.uint32).tobytes())
            rows["own"].append(idx.astype(np.uint32).tobytes())
            rows["tokens"].append(token[pick].tobytes())
            rows["ranks"].append(rank[pick].tobytes())
        return pa.table({"part": pa.array(rows["part"], pa.int32()), **{c: pa.array(rows[c], pa.binary()) for c in ("sids", "ns", "own", "tokens", "ranks")}})

    def gather(t: pa.Table) -> pa.Table:
        sid, size, token, rank = [], [], [], []
        for sids, ns, own, tokens, ranks in zip(*(t.column(c).to_pylist() for c in ("sids", "ns", "own", "tokens", "ranks")), strict=True):
            o = np.frombuffer(own, np.uint32)
            sid.append(np.frombuffer(sids, np.uint64)[o])
            size.append(np.frombuffer(ns, np.uint32)[o])
            token.append(np.frombuffer(tokens, np.uint64))
            rank.append(np.frombuffer(ranks, np.uint8))
        sid, size, token, rank = (np.concatenate(x) for x in (sid, size, token, rank))
        who, idx, many = np.unique(sid, return_inverse=True, return_counts=True)
        enough = 100 * many >= percent * size[np.unique(sid, return_index=True)[1]].astype(np.int64)
        keep = enough[idx]
        sid, size, token, rank = sid[keep], size[keep], token[keep], rank[keep]
        order = np.lexsort((token, rank, sid))
        sid, size, token = sid[order], size[order], token[order]
        at = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]])) if len(sid) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(sid))[: len(at)]
        return pa.table({"sid": pa.array(sid[at].view(np.int64)), "n": pa.array(size[at], pa.int64()), "tokens": pa.array([token[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())})

    blobs = src.mapInArrow(T.lean(emit), "bucket int, sids binary, ns binary, own binary, low binary, high binary")
    counted = blobs.groupBy("bucket").applyInArrow(T.lean_group(count), "part int, sids binary, ns binary, own binary, tokens binary, ranks binary")
    return counted.groupBy("part").applyInArrow(T.lean_group(gather), "sid long, n long, tokens binary")


def index(sets: DataFrame, percent: int) -> DataFrame:
    """Entries (token, sid, n, left): the prefix of each set, with how many of its shared tokens come after."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column("n"))
            blobs = b.column("tokens").to_pylist()
            have = np.array([len(x) // 8 for x in blobs], np.int64)
            need = -(-percent * n // 100)
            take = np.minimum(np.maximum(have - need + 1, 0), have)
            flat = np.frombuffer(b"".join(blobs), np.int64)
            first = np.cumsum(have) - have
            row = np.repeat(np.arange(len(n)), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            yield pa.RecordBatch.from_arrays([pa.array(flat[first[row] + place]), b.column("sid").take(pa.array(row)), pa.array(n[row]), pa.array(have[row] - place, pa.int64())], names=["token", "sid", "n", "left"])

    return sets.mapInArrow(T.lean(own), "token long, sid long, n long, left long")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b and inter of each pair of set ids."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "t_a", "t_b")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            kept, name = None, None
            for i, (a, x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("t_a").to_pylist(), b.column("t_b").to_pylist(), strict=True)):
                if a != name:  # pairs come grouped by their pivot
                    kept, name = np.sort(np.frombuffer(x, np.uint64)), a
                other = np.frombuffer(y, np.uint64)
                if len(kept) and len(other):
                    at = np.minimum(np.searchsorted(kept, other), len(kept) - 1)
                    out[i] = int((kept[at] == other).sum())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("n_a"), b.column("n_b"), pa.array(out)], names=["a", "b", "n_a", "n_b", "inter"])

    return both.mapInArrow(T.lean(own), "a long, b long, n_a long, n_b long, inter long")


#: Links that one task may group on its own (16 bytes each); more are grouped by rounds of joins.
LOCAL_LINKS = 1_000_000


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least node of each node's component, by hooking and pointer jumping."""
    got = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        if (a == b).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]
    keep = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]])], names=["node", "root"])


def few(df: DataFrame) -> DataFrame:
    """The rows in fewer partitions: tables of links are small beside the index they come from."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """node and root (the least node of its component) of all nodes that are no roots.

    The rounds of joins end when the links stay the same, at the latest after about the square of the logarithm of the
    nodes.
    """
    now = cut(few(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()))
    if now.count() <= local:
        return now.coalesce(1).mapInArrow(T.lean(_grouped), "node long, root long")

    def large(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    before = None
    while True:
        now = cut(small(large(now)))
        state = now.agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (state["c"], state["h"]) == before:
            break
        before = (state["c"], state["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def links(sets: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, local: int = LOCAL_LINKS) -> DataFrame:
    """Group (root) of every set id that links with another: sid, root."""
    spark = sets.sparkSession
    reach = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    linked = (100 + percent) * F.col("inter") >= percent * (F.col("n_a") + F.col("n_b"))
    # seen from a pair's first common token, no more than what lies ahead in both can be common
    ahead = F.least("left", "pl") * F.lit(100 + percent) >= percent * (F.col("n") + F.col("m"))
    # sizes in reach of each other lie in the same block or in neighbouring ones
    block = F.floor(F.log(F.col("n")) / F.log(F.lit(100.5 / percent))).cast("int")
    entries = index(sets, percent)
    lists = entries.groupBy("token").agg(F.count("*").alias("long")).filter("long > 1")
    entries = entries.join(lists, "token").select("token", "sid", "n", "left", F.col("sid").alias("root"))
    done = cut(spark.createDataFrame([], "a long, b long, n_a long, n_b long, inter long"))
    found = cut(spark.createDataFrame([], "u long, v long"))
    groups = None

    def settled(e: DataFrame) -> DataFrame:
        """Entries of the lists that still hold several groups, with the list's largest one."""
        sizes = e.groupBy("token", "root").agg(F.count("*").alias("c"))
        top = sizes.groupBy("token").agg(F.max(F.struct("c", "root")).alias("x"), F.count("*").alias("many"), F.sum("c").alias("total")).filter("many > 1")
        return cut(e.join(top.select("token", F.col("x.root").alias("top"), "total"), "token").select("token", "sid", "n", "left", "root", "top", "total"))

    def answered(got: DataFrame) -> None:
        nonlocal found, groups
        found = cut(few(found.unionByName(got.filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v")))))
        groups = cut(few(_with_roots(components(found, local=local))))

    open_, all_, links_ = settled(entries), None, 0
    for k in range(rounds):
        state = open_.agg(F.count("*").alias("n"), F.sum(F.when(F.col("root") != F.col("top"), F.col("total")).otherwise(0)).alias("pairs")).first()
        all_ = all_ or state["n"]
        if not state["n"] or (k and state["pairs"] <= PAIRS_EACH * all_):
            break
        pivots = open_.filter("root = top").groupBy(F.col("token").alias("pt")).agg(F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("h"), F.col("sid").alias("p"), F.col("n").alias("m"), F.col("left").alias("pl"))).alias("x")).select("pt", "x.p", "x.m", "x.pl")
        pairs = open_.filter("root <> top").join(pivots, F.col("token") == F.col("pt")).filter(reach(F.col("n"), F.col("m")) & ahead)
        pairs = pairs.groupBy("sid", "p").agg(F.count("*").alias("c")).join(done.select(F.col("a").alias("p"), F.col("b").alias("sid")), ["p", "sid"], "left_anti")
        # the pivots that lead most of a member's lists
        best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("c"), "p"))).filter(F.col("r") <= PIVOTS).select(F.col("p").alias("a"), F.col("sid").alias("b"))
        got = cut(compare(best, sets))
        if got.isEmpty():
            break
        done = cut(few(done.unionByName(got)))
        new = got.filter(linked).count()
        links_ += new
        if new:
            answered(got)
        if groups is None:
            break
        now = open_.select("token", "sid", "n", "left").join(groups, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", "left", F.coalesce("root", "sid").alias("root"))
        open_ = settled(now)
        if new <= LEAST_GAIN * links_:
            break
    # what still crosses groups: all entries but those of a list's largest group probe the list
    open_ = open_.withColumn("block", block)
    probe = open_.filter("root <> top").select("token", F.col("sid").alias("p"), F.col("root").alias("pr"), F.col("n").alias("m"), F.col("left").alias("pl"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    once = (F.col("root") == F.col("top")) | (F.col("sid") < F.col("p"))
    cross = open_.join(probe, ["token", "block"]).filter((F.col("root") != F.col("pr")) & once & reach(F.col("n"), F.col("m")) & ahead)
    pairs = cross.select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")).distinct()
    pairs = pairs.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    # distances to a common pivot: |d(x, p) - d(y, p)| <= d(x, y)
    d = done.select(F.col("a").alias("pivot"), F.col("b").alias("s"), (1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("d")).groupBy("s").agg(F.max(F.struct("pivot", "d")).alias("x")).select("s", "x.pivot", "x.d")
    x, y = d.select(F.col("s").alias("a"), F.col("pivot").alias("qa"), F.col("d").alias("da")), d.select(F.col("s").alias("b"), F.col("pivot").alias("qb"), F.col("d").alias("db"))
    far = (F.col("qa") == F.col("qb")) & (F.abs(F.col("da") - F.col("db")) > 1 - percent / 100 + 1e-9)
    pairs = pairs.join(x, "a", "left").join(y, "b", "left").filter(~F.coalesce(far, F.lit(False))).select("a", "b")
    got = cut(compare(pairs, sets))
    if not got.isEmpty():
        answered(got)
    if groups is None:
        groups = spark.createDataFrame([], "node long, root long")
    return groups.select(F.col("node").alias("sid"), "root")


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, local: int = LOCAL_LINKS, hot: int = HOT_CLASSES) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (hash of the text) and group (null for empty sets) of every row.

    Ids are whole numbers; a null id belongs to its group but never names it.
    """
    both = cut(classes(docs, doc, text, width, hot))
    own = both.filter("token IS NULL").select("doc_id", "text_key", "sid", "n")
    total = own.agg(F.sum("n").alias("n")).first()["n"] or 0
    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(total // BUCKET_ROWS) + 1)
    heavy = both.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT_SHARE * total).select("token").toArrow()
    sets = cut(shared(docs, text, width, buckets, buckets, percent, np.sort(np.asarray(heavy.column("token")).astype(np.uint64))))
    roots = links(sets, percent, local=local)
    grouped = own.join(roots.withColumnRenamed("sid", "r_sid"), F.col("sid") == F.col("r_sid"), "left").withColumn("g", F.when(F.col("n") > 0, F.coalesce("root", "sid")))
    least = grouped.filter("g is not null").groupBy(F.col("g").alias("l_g")).agg(F.min("doc_id").alias("least"))
    out = grouped.join(least, F.col("g") == F.col("l_g"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "text_key", F.col("g").alias("group"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Texts with the same words are one class; classes meet by shingle, and a class is joined to all it reaches.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
c AS MATERIALIZED (SELECT ws, min(doc_id) AS least, row_number() OVER () AS c FROM d GROUP BY ws),
u AS MATERIALIZED (SELECT DISTINCT c, unnest(CASE WHEN len(ws) < {WIDTH} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {WIDTH} + 2), lambda i: array_to_string(ws[i:i + {WIDTH} - 1], ' ')) END) AS g FROM c WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT c, count(*) AS n FROM u GROUP BY c),
b AS (SELECT x.c AS p, y.c AS q, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.c <> y.c GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p, q FROM b JOIN n np ON np.c = p JOIN n nq ON nq.c = q WHERE 100 * k >= {PERCENT} * (np.n + nq.n - k)),
r AS (SELECT c AS p, c AS q FROM c UNION SELECT r.p, e.q FROM r JOIN e ON e.p = r.q),
o AS (SELECT r.p AS c, min(least) AS component_id FROM r JOIN c ON c.c = r.q GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d JOIN c ON c.ws = d.ws JOIN o ON o.c = c.c LEFT JOIN n ON n.c = c.c
"""
