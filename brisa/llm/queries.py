"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.llm import alignment, debruijn, embeddings, lexical, style_tree, token_trees, toxicity, warc
from brisa.llm.common import table
from brisa.llm.fingerprint import edited_likeness
from brisa.llm.mixing import mix
from brisa.llm.packing import packed
from brisa.llm.simhash import near_duplicates
from brisa.llm.suffix import without_repeats
from brisa.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_document_fingerprints")
def op1(spark, folder):
    return edited_likeness(table(spark, folder, "documents"))


@query("op9_simhash_near_dedup")
def op9(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"), size=4, distance=4)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_best_fit_packing")
def op8(spark, folder):
    return packed(table(spark, folder, "documents"), vocabulary(), capacity=1024, end=2)


@query("op5_mixing_sources")
def op5(spark, folder):
    mixed = mix(table(spark, folder, "documents"), weights=(3, 1, 2), amount=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: Labelled rows whose remainder is 0 are held out of training.
REMAINDER = "crc32(cast(cast(doc_id AS string) AS binary)) % 5"


@query("op3_toxicity")
def op3(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, "toxic", F.expr(f"{REMAINDER} <> 0"))
    scored = docs.select("doc_id", F.expr(f"{REMAINDER} = 0").alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op4_suffix_array_dedup")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = without_repeats(docs, length=400, rule="other").select("doc_id", "cut_.*")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup")
def op10(spark, folder):
    cut = debruijn.without_repeats(table(spark, folder, "documents"), length=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_embedding_near_dedup")
def op7(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings"), threshold=0.95)


@query("op2_token_counts")
def op2(spark, folder):
    """Three edits a text: its middle replaced by its first characters, a part left out, its last characters repeated."""
    docs = table(spark, folder, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    change = lambda start, removed, inserted: F.struct(
        F.floor(start).cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted")
    )
    text = F.coalesce("text", F.lit(""))
    edits = F.array(
        change(size / 4, 16, F.lit("")), change(size / 2, 8, F.substring(text, 1, 24)), change(size, 0, F.substring(text, -12, 12))
    )
    return token_trees.counts_after_edits(docs, edits, vocabulary())


WARC_SQL = """
WITH numbered AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url,
         row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages),
sized AS (
  SELECT *, strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
     || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html'
     || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
     || chr(13) || chr(10) || chr(13) || chr(10)) AS length FROM numbered),
placed AS (
  SELECT CAST(place // 1000 AS BIGINT) AS file, CAST(place % 1000 AS BIGINT) AS record_no, page_id, html, CAST(length AS BIGINT) AS length,
         CAST(sum(length) OVER (PARTITION BY place // 1000 ORDER BY place) - length AS BIGINT) AS "offset" FROM sized)
SELECT file, record_no, "offset", length, page_id,
       CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 211 = 5 OR (page_id % 50 = 17 AND reverse(html) <> html)
"""


@query("op6_warc_fixity", WARC_SQL)
def op6(spark, folder):
    """The replica lost some records and holds others with their pages' characters the other way round."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    held = F.when(F.expr("page_id % 50 = 17"), F.reverse("html")).otherwise(F.col("html"))
    read = F.sha2(warc.record(F.col("url"), F.col("page_id"), held), 256)
    records = warc.manifest(pages.withColumn("read", read), "read")
    replica = records.where("NOT coalesce(page_id % 211 = 5, false)").withColumn("sha256", F.col("read"))
    return warc.audit(records.drop("read"), replica.drop("read"))


@query("op11_html_extraction")
def op11(spark, folder):
    return style_tree.extract(table(spark, folder, "pages"))


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_token_alignment")
def op12(spark, folder):
    return alignment.align(table(spark, folder, "documents"), vocabulary(), piece_vocabulary())


SEARCH_SQL = r"""
WITH held AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT doc_id, len(terms) AS n FROM held WHERE len(terms) > 0),
whole AS (SELECT count(*) AS number, CAST(sum(n) AS BIGINT) AS total FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(number) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * number) // total))) AS impact
  FROM counts JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
