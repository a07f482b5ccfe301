"""Range sharding by sampled splitters (native: DataFrame functions only).

A record's key is the hash of its text, then the hash of its id, so equal texts lie next to
each other and no key repeats unless a row does. A sample drawn with probability in
proportion to size gives quantile boundaries for many more ranges than shards; they lie between
different texts. The ranges' exact sizes are then counted. A range with too many bytes is
sampled again on its own and subdivided: between texts as long as it holds several, else between
ids. Every round parts each such range, and rounds go on until none is overfull or
only one key is left in it. Ranges then go to the shards, the largest first, each to the emptiest.

Law: ``bytes``. The ranges of one text stay together in one shard if they fit, that is, if they hold no more than an
even share of all bytes; a larger group is dealt by its ranges, as the shards' sizes have to be equal.

Defined results: a null text has size 1 and the checksum of the empty text; a repeated row
shares its key and range, and has a slot of its own; null ids are dealt like others; ties are
broken by range and key; a very long text is a row like others, of which only hashes move on; extra
columns are ignored; an empty table gives an empty result.

Scale: one pass over the texts leaves 50 bytes a row in the shared folder. Boundaries are
numbered by binary search in a constant array. Ranges are what the driver sees: their number is
``shards * RANGES``, or the rows over ``ROWS_EACH``, and about twice that after subdividing. Slots are counted
within ranges, never over a whole shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import cut, table

SHARDS = 16
#: Ranges for each shard at first, sampled keys for each range, most rows a range should hold.
RANGES, SAMPLES, ROWS_EACH = 128, 16, 500_000
#: Hexadecimal digits of a key that belong to the text, and a character behind all of them.
TEXT, BEHIND = 16, "~"


def _range_of(key: Column, bounds: list[str]) -> Column:
    """Number of bounds that are at or below the key: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    width = 1 << (len(bounds)).bit_length()
    steps = [width >> k for k in range(1, width.bit_length())]
    padded = F.lit(bounds + ["~"] * (width - len(bounds)))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) <= key, at + step).otherwise(at))


def _draw(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """Keys drawn with a chance of ``size * rate``; a drawn key weighs the inverse of its chance."""
    chance = F.least(F.lit(1.0), F.col("size") * rate)
    even = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.withColumn("chance", chance).filter(even < F.col("chance")).withColumn("weight", F.col("size") / F.col("chance"))


def _quantiles(sample: DataFrame, parts: Column, by: list[str]) -> list[str]:
    """Keys that part the sample of each group in ``parts`` spans of equal weight."""
    w = Window.partitionBy(*by).orderBy("key")
    run = sample.withColumn("upto", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("weight").over(Window.partitionBy(*by)))
    run = run.withColumn("span", F.floor(F.coalesce("upto", F.lit(0.0)) * parts / F.col("all")))
    first = run.groupBy(*by, "span").agg(F.min("key").alias("key")).filter("span > 0")
    return sorted({r["key"] for r in first.select("key").collect()})


def _parted(bounds: list[str], drawn: list[str], over: list) -> list[str]:
    """The bounds with more of them in every overfull range, given as rows with its lowest and highest key."""
    found = set(bounds)
    for r in over:
        lo, hi, deep = r["lo"], r["hi"], r["lo"][:TEXT] == r["hi"][:TEXT]
        inside = drawn[bisect_left(drawn, lo) : bisect_right(drawn, hi)]
        new = set(inside) if deep else {x for k in inside for x in (k[:TEXT], k[:TEXT] + BEHIND)}
        new = {x for x in new if lo < x <= hi} - found
        found |= new or {hi if deep else hi[:TEXT]}
    return sorted(found)


def _dealt(ranges: list, shards: int) -> list[tuple[int, int, int]]:
    """Range, shard and first slot of every range, the largest first to the emptiest shard; ranges of one text together if they fit."""
    share = sum(r["bytes"] for r in ranges) / shards
    texts: dict[str, list] = {}
    for r in ranges:
        own = r["lo"][:TEXT]
        texts.setdefault(own if own == r["hi"][:TEXT] else r["lo"] + BEHIND, []).append(r)
    units = [u for own in texts.values() for u in ([own] if sum(r["bytes"] for r in own) <= share else [[r] for r in own])]
    units.sort(key=lambda u: (-sum(r["bytes"] for r in u), u[0]["range"]))
    filled = [(0, k) for k in range(shards)]
    slots, out = [0] * shards, []
    for u in units:
        held, k = heappop(filled)
        for r in u:
            out.append((r["range"], k, slots[k]))
            slots[k] += r["n"]
            held += r["bytes"]
        heappush(filled, (held, k))
    return out


def assign(docs: DataFrame, shards: int = SHARDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, key, shard, slot."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.concat(F.lpad(F.hex(F.xxhash64(body)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.col(doc).cast("string"))), 16, "0")).alias("key"),
    )
    rows = cut(rows)
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    ranges = shards * max(RANGES, -(-total["n"] // (shards * ROWS_EACH)))
    target = total["b"] / ranges
    sample = _draw(rows, F.lit(ranges * SAMPLES / total["b"]), 1).withColumn("g", F.lit(0))
    bounds = sorted({k[:TEXT] for k in _quantiles(sample, F.lit(ranges), ["g"])})
    seed = 1
    while True:
        placed = rows.withColumn("range", _range_of(F.col("key"), bounds))
        counts = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        over = [r for r in counts if r["bytes"] > 1.5 * target and r["lo"] < r["hi"]]
        if not over:
            break
        seed += 1
        again = placed.join(F.broadcast(rows.sparkSession.createDataFrame([(r["range"],) for r in over], "range int")), "range")
        bounds = _parted(bounds, _quantiles(_draw(again, F.lit(2 * SAMPLES / target), seed), F.ceil(F.col("all") / F.lit(target / 2)), ["range"]), over)
    places = rows.sparkSession.createDataFrame(_dealt(counts, shards), "range int, shard int, base long")
    inside = Window.partitionBy("range").orderBy("key", "text_crc32")
    # one row a range, and ranges have the bound above
    return placed.withColumn("at", F.row_number().over(inside)).join(F.broadcast(places), "range").select("doc_id", "size", "text_crc32", "key", "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
