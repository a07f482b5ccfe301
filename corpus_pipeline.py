"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next stage's documents. The stages keep every column; where a stage changes
a text, ``n_chars`` follows it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import jaccard, packing, quality, repeats, toxicity
from footfall.llm.common import stored, table

#: Least bytes of a repeated string that the pipeline removes: a passage of over 50 words is hardly ever shorter.
PASSAGE = 250


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, with n_chars as the text now has."""
    length = F.char_length("text").cast("long")
    return docs.select(*[F.when(F.col("text").isNull(), F.col(c)).otherwise(length).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines are removed; documents that fail the base rules or lose too much go."""
    return _recounted(quality.clean(docs), docs.columns)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, keep=docs.columns).filter(F.col("_score") < toxicity.CUT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id, and of equal ids that with the least text hash.

    A null id comes after all others. Texts without words are in no group and stay. Rows that
    agree in id and text are copies of each other, of which the one with the least hash of all columns stays; an
    id that stands on different texts is judged text by text.
    """
    key = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    told = stored(jaccard.join(docs))
    first = told.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("s")).select("s.doc_id", "s.text_key", F.lit(True).alias("one"))
    stay = first.unionByName(told.filter("group IS NULL").select("doc_id", "text_key", F.lit(False).alias("one")).distinct()).toDF("_stay_doc", "_stay_key", "_stay_one")
    again = told.filter("group IS NOT NULL").groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("_again_doc"), F.col("text_key").alias("_again_key"))
    kept = docs.join(stay.select("_stay_doc", "_stay_key"), docs["doc_id"].eqNullSafe(F.col("_stay_doc")) & (key == F.col("_stay_key")), "left_semi")
    if again.isEmpty():
        return kept
    twice = kept["doc_id"].eqNullSafe(F.col("_again_doc")) & (key == F.col("_again_key"))
    rows = F.struct(*[kept[c] for c in kept.columns])
    single = kept.join(again, twice, "left_semi").select(key.alias("k"), rows.alias("r")).groupBy("r.doc_id", "k").agg(F.min_by("r", F.xxhash64(F.to_json("r"))).alias("r"))
    return kept.join(again, twice, "left_anti").unionByName(single.select("r.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of at least PASSAGE bytes that stand elsewhere too are removed; every row stays.

    A text none of which repeats stays as it is, null included; one that repeats as a whole becomes empty.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = repeats.dedup(docs, carry=carry, least=PASSAGE).withColumnsRenamed({"_id": "doc_id", "_clean": "text"})
    return _recounted(out, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, dealt to sequences."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_filter),
    ("ngram_jaccard", near_duplicates),
    ("repeat_removal", repeated_passages),
    ("packing", pack_sequences),
]

#: The classifier, the hash order of its sample and the packing plan have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it return is written below the shared folder."""
    from footfall.llm.common import shared_folder

    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
