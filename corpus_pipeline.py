"""A training corpus from raw documents: toxic ones go, near and exact repeats go, sources are mixed, tokens are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs. All
but the last return the columns of the documents. Nulls, empty texts and repeated rows are handled by the operators as
their modules say; what a stage adds to that stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.llm import mixing, packing, simhash, suffix, toxicity
from brisa.llm.common import small_batches, stored, table
from brisa.llm.queries import REMAINDER, vocabulary
from brisa.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half; trained on the labels of ``sf_dir`` that are not held out.

    Empty and null texts score low and stay. Without labels of both kinds everything stays.
    """
    small_batches(prepare(spark))
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", F.expr(f"{REMAINDER} <> 0"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; of rows that repeat its id, the least one.

    Rows without an id cannot be named, and all stay.
    """
    small_batches(prepare(spark))
    found = simhash.near_duplicates(docs, size=4, distance=4)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows_"))
    first = stored(first, "first-documents")
    kept = docs.join(first.where("rows_ = 1"), "doc_id", "left_semi")
    again = first.where("rows_ > 1")
    if not again.isEmpty():
        rest = [c for c in docs.columns if c != "doc_id"]
        least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("least_"))
        kept = kept.unionByName(least.select("doc_id", *[F.col("least_")[c].alias(c) for c in rest]))
    return kept.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches of 400 bytes or more that occur earlier, nor the passages of over 50 words, of
    whatever length, that a document of smaller id holds; ``n_chars`` follows the text.

    Both are judged on the input, whose first places stay. Only whole characters go. A text that is all repeats stays as an empty one; a null text stays null.
    """
    small_batches(prepare(spark))
    cut = suffix.cut_documents(docs, length=400, rule="first", characters=True, words=51)
    changed, row = F.col("cut.n_removed") > 0, F.col("row")
    kept = {"text": F.decode("cut.kept", "UTF-8")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length(kept["text"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(
        [(F.when(changed, kept[c]).otherwise(row[c]) if c in kept else row[c]).alias(c) for c in docs.columns]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Rows that repeat an id are taken alike, as often as the one that is taken most.
    """
    small_batches(prepare(spark))
    mixed = mixing.mix(docs, weights=(3, 1, 2), amount=1.5, most=2.0)
    taken = mixed.groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    whole = docs.select(F.struct("*").alias("row"))
    found = whole.join(taken, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    copies = found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select([F.col("row")[c].alias(c) for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place in it."""
    small_batches(prepare(spark))
    return packing.packed(docs, vocabulary(), capacity=1024, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_tokens),
]

#: No stage's decisions can be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
