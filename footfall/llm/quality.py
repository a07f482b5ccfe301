"""Cross-document line frequency (native: DataFrame functions only).

Every line is normalised (words joined by one space, lower case) and hashed. For each host the
distinct documents that hold a line are counted; documents whose whole normalised texts
are equal are one document there, so that copies cannot make prose look like boilerplate. A line
that stands in at least ``MIN_DOCS`` documents and in more than ``MIN_SHARE`` of the host's is removed, and a document
that loses more than ``MAX_LOSS`` of its words is rejected. Passages that fewer documents of a host
share, and near copies, are left to the operators made for them.

Defined results: null text is an empty text; a null host is a host of its own; every row has a
verdict of its own, which depends on its text and host alone, so repeated rows, null ids and ties
agree; texts of one line are documents like others; a very long text is worked on whole, within
one row of the JVM; extra columns, whatever their names, are ignored (``measure``) or kept (``clean``);
an empty table gives an empty result. Lines and documents are told apart by 64-bit hashes.

Scale: texts are read once and leave as counts and 8-byte line hashes; ``clean`` stores the texts
that pass the base rules beside them, and no text is shuffled or sorted. Counting is two
partial aggregations, keyed by host, line and document first, so that a hot host or line is spread.
Lines above the limits are broadcast, as one list for each host, while they are few by count, and every document is
judged where it lies (a host's list has at most 1 / MIN_SHARE times the lines of its mean document); beyond that, only the heaviest
lines are broadcast (a line on 1/10,000 of all line rows: at most 10,000 of them), the others, none of which
holds a larger share, are joined by shuffle, and so are the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import WORD, cut, stored

#: A line is removed at both: least distinct documents on the host, share of the host's distinct documents.
MIN_DOCS, MIN_SHARE = 10, 0.05
#: A document is rejected if more than this share of its words goes.
MAX_LOSS = 0.5
#: Base rules: least words, largest percentage of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEAT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Up to so many frequent lines (24 bytes each) are broadcast as they are.
BROADCAST_LINES = 200_000
HEAVY = 10_000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("raw"), F.regexp_extract_all(s, F.lit(WORD), F.lit(0)).alias("words"))), lambda x: F.size(x["words"]) > 0)


def normal_hash(words: Column) -> Column:
    """Hash of a line's or a text's normal form."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def measure(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of every document, its base verdict, and the method's.

    Returns one row for each row of ``docs``: doc_id, text_key, host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, removed_words, removed_lines (hashes), kept.
    """
    return _judged(docs, doc, text, host, {})


def _judged(docs: DataFrame, doc: str, text: str, host: str, carry: dict[str, str]) -> DataFrame:
    """``measure``, with the columns of ``docs`` that ``carry`` names as it names them; a text that fails the base rules is left out (null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    stats = docs.select(
        F.col(doc).alias("doc_id"),
        F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_key"),
        F.col(host).cast("string").alias("host"),
        let(
            _lines(body),
            lambda ls: F.struct(
                let(
                    F.flatten(ls["words"]),
                    lambda ws: F.struct(
                        normal_hash(ws).alias("whole"),
                        F.size(ws).cast("long").alias("n_words"),
                        F.aggregate(ws, F.lit(0), lambda a, w: a + F.char_length(w)).cast("long").alias("word_chars"),
                        _repeats(ws).cast("long").alias("n_repeat_words"),
                    ),
                ).alias("w"),
                (F.size(ls) - F.size(F.array_distinct(ls["raw"]))).cast("long").alias("n_dup_lines"),
                F.transform(ls, lambda x: F.struct(normal_hash(x["words"]).alias("line"), F.size(x["words"]).alias("words"))).alias("lines"),
            ),
        ).alias("s"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        *[F.col(c).alias(n) for c, n in carry.items()],
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    base = stats.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "host", "s.w.*", "s.n_dup_lines", "n_symbols", "s.lines", *carry.values())
    base = stored(base.withColumn(carry[text], F.when(~failed, F.col(carry[text])))) if carry else cut(base)
    host_key = [F.coalesce("host", F.lit("")).alias("f_host"), F.col("host").isNull().alias("f_null")]
    held = base.select("row", *host_key, "whole", F.explode("lines").alias("l")).select("row", "f_host", "f_null", "whole", F.col("l.line").alias("f_line"), F.col("l.words").alias("words"))
    keys = ["f_host", "f_null", "f_line"]
    counts = held.groupBy(*keys, "whole").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("c").alias("c")).filter(F.col("n") >= MIN_DOCS)
    sizes = base.select(*host_key, "whole").groupBy("f_host", "f_null", "whole").agg(F.lit(1).alias("one")).groupBy("f_host", "f_null").agg(F.count("*").alias("of"))
    frequent = cut(counts.join(sizes, ["f_host", "f_null"]).filter(F.col("n") > MIN_SHARE * F.col("of")).select(*keys, "c"))
    if frequent.count() <= BROADCAST_LINES:
        often = frequent.groupBy("f_host", "f_null").agg(F.collect_list("f_line").alias("often"))
        found = lambda hit: F.struct(F.aggregate(F.filter("lines", lambda x: F.array_contains(hit, x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("lost"), hit.alias("lines_out"))
        hits = F.when(F.col("often").isNotNull(), let(F.array_intersect(F.transform("lines", lambda x: x["line"]), "often"), found))
        rows = base.join(F.broadcast(often), (host_key[0] == F.col("f_host")) & (host_key[1] == F.col("f_null")), "left").withColumn("hits", hits).select(*base.columns, "hits.lost", "hits.lines_out")
    else:
        heavy = held.count() // HEAVY
        top = F.broadcast(frequent.filter(F.col("c") >= heavy).select(*keys))
        hit = held.join(top, keys).unionByName(held.join(top, keys, "left_anti").join(frequent.filter(F.col("c") < heavy).select(*keys), keys))
        rows = base.join(hit.groupBy("row").agg(F.sum("words").cast("long").alias("lost"), F.collect_set("f_line").alias("lines_out")), "row", "left")
    removed = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), removed.alias("removed_words"),
        F.coalesce("lines_out", F.array().cast("array<long>")).alias("removed_lines"), (~failed & (removed <= MAX_LOSS * F.col("n_words"))).alias("kept"), *carry.values(),
    )


def clean(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that stay, without the removed lines; all columns of ``docs``."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    kept = _judged(docs, doc, text, host, names).filter("kept")
    rest = F.array_join(F.filter(F.split(names[text], "\n"), lambda s: ~F.array_contains(F.col("removed_lines"), normal_hash(F.regexp_extract_all(s, F.lit(WORD), F.lit(0))))), "\n")
    return kept.select(*[F.when(F.size("removed_lines") == 0, F.col(n)).otherwise(rest).alias(c) if c == text else F.col(n).alias(c) for c, n in names.items()])


def query(spark, sf_dir: str) -> DataFrame:
    from footfall.llm.common import table

    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    return measure(table(spark, sf_dir, "documents")).select(*cols)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, source, row_number() OVER () AS lid, l, regexp_extract_all(l, '{WORD}') AS ws
      FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)),
lw AS (SELECT doc_id, source, l, len(ws) AS n, md5(lower(array_to_string(ws, ' '))) AS h FROM l WHERE len(ws) > 0),
wh AS (SELECT doc_id, source, md5(lower(array_to_string(regexp_extract_all(t, '{WORD}'), ' '))) AS whole FROM d),
sz AS (SELECT source, count(DISTINCT whole) AS of_host FROM wh GROUP BY source),
fr AS (SELECT lw.source, h, count(DISTINCT whole) AS docs FROM lw JOIN wh USING (doc_id) GROUP BY lw.source, h),
bad AS (SELECT fr.source, h FROM fr JOIN sz ON fr.source IS NOT DISTINCT FROM sz.source WHERE docs >= {MIN_DOCS} AND docs > {MIN_SHARE} * of_host),
lost AS (SELECT lw.doc_id, sum(n)::BIGINT AS lost FROM lw JOIN bad ON lw.h = bad.h AND lw.source IS NOT DISTINCT FROM bad.source GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM lw GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM wd WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
gg AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS r FROM g),
cv AS (SELECT doc_id, r OR coalesce(lag(r, 1) OVER p, false) OR coalesce(lag(r, 2) OVER p, false) AS c FROM gg WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rp AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n_rep FROM cv GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM wd GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
      coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words) AS base_failed, removed_words,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words) AND removed_words <= {MAX_LOSS} * n_words AS kept
FROM m
"""
