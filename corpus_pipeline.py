"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

A stage gets the documents that its predecessor wrote and returns rows with the columns of documents;
the last one returns each document's place in the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfactor.llm.common import checkpointed, counted, scratch, shared_dir, table
from gridfactor.llm.decontaminate import contamination
from gridfactor.llm.jaccard_join import jaccard_components
from gridfactor.llm.language_id import fit_profiles, identified
from gridfactor.llm.mixing import drawn_documents, mix_sources
from gridfactor.llm.sharding import minimax_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter in it, or hardly an n-gram that any language has (a score under 0.1).

    Where no document has a label, no language is known, and only documents without a letter go.
    """
    return identified(docs, fit_profiles(docs), least_score=0.1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, similarity 0.8 or more), the row with the smallest key stays.

    A row's key is its id (null is the largest), its text's hash together with the id, and its number among equal
    rows; so rows that share an id, and rows without one, are compared like others.  Of repeated rows (equal id
    and text) one stays, but all rows that have neither an id nor a word.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.withColumn("__key", key)
    found = jaccard_components(keyed, k=5, percent=80, id_col="__key")
    links = checkpointed(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__component")).distinct())
    heads = links.select(F.col("__component").alias("__row"), "__component").distinct()
    members = counted(links.unionByName(heads))
    rows = keyed.select("doc_id", "__key").join(members, F.col("__key") == F.col("__row")).select("__component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__key").alias("row")).distinct()
    first = rows.groupBy("__component").agg(F.min("row").alias("first"))
    gone = counted(rows.join(first, "__component").where("row <> first").select(F.col("row.doc_id").alias("__id"), F.col("row.__key").alias("__gone")).distinct())
    kept = keyed.join(gone, (F.col("__key") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    named = F.col("doc_id").isNotNull() | F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0d]")
    again = counted(keyed.where(named).groupBy(F.col("__key").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"))
    # a grouped minimum, which every task begins with its own rows: one row may be repeated any number of times
    repeated = kept.join(again, F.col("__key") == F.col("__again"), "left_semi").groupBy("__key", F.col("doc_id").alias("__id"))
    repeated = repeated.agg(F.min_by(F.struct(*docs.columns), F.struct("source", "lang")).alias("__row")).select("__row.*")
    once = kept.join(again, F.col("__key") == F.col("__again"), "left_anti")
    return once.select(docs.columns).unionByName(repeated.select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more are in benchmark windows go."""
    bad = counted(contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    return drawn_documents(docs, mix_sources(docs)).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return minimax_shards(docs, 16)


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
#: SQL can't express the language model, the quota tree and the minimax cuts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again, and what it stored on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
