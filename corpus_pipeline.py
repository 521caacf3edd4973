"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import jaccard, mixing, packing, substring_dedup, toxicity
from seqloom.llm.common import cut, fresh, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go.

    Null and empty texts have the score of the bias alone; rows of equal id or text are scored alike; an empty table stays empty.
    """
    model = toxicity.trained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh("__score", docs.columns)
    return toxicity.score(docs, *model, score_col=score).where(F.col(score) < 0.7).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one with the smallest id stays.

    Null, empty and wordless texts are linked with nothing and stay, as rows without an id do. Rows of equal id are rows
    of their own: of those that are linked one stays, and of equal ones one.
    """
    found = jaccard.join(docs).where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = found.where("component_id = doc_id").groupBy("doc_id").agg(F.min("tag").alias("first"), F.count("*").alias("n"))
    seen = found.join(first.withColumnRenamed("doc_id", "component_id"), "component_id")
    # A row goes if its component has a smaller id, or another text with the same id that comes first.
    gone = seen.where("component_id < doc_id OR tag <> first").select("doc_id", "tag").distinct()
    again = cut(seen.where("component_id = doc_id AND tag = first AND n > 1").select("doc_id", "tag").distinct())
    tag = fresh("__tag", docs.columns)
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    meets = lambda t: (tagged["doc_id"] == t["doc_id"]) & (tagged[tag] == t["tag"])
    kept = tagged.join(gone, meets(gone), "left_anti")
    if again.limit(1).count():  # rows that may repeat
        kept = kept.join(again, meets(again), "left_anti").unionByName(kept.join(again, meets(again), "left_semi").dropDuplicates(["doc_id", tag]))
    return kept.select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words that an earlier document has go; documents of which nothing is left go with them.

    Null and empty texts stay, as rows without an id do, whole; rows of equal id take nothing from each other.
    """
    own = {c: fresh(f"__{c}", docs.columns) for c in docs.columns if c.lower() not in ("doc_id", "text")}
    kept = substring_dedup.dedup(docs.withColumnsRenamed(own), keep_text=True).where("n_words = 0 OR n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(own["n_chars"])).alias("n_chars")
    return kept.select(*[chars if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without a word belong to no share and go."""
    return mixing.repeat(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their sequences; a null text is an empty one, equal rows are rows of their own."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Models, hashes and tokenizers decide; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what the last one returns is read back, too."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
