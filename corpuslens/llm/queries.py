"""The registered queries of the dealt operators over the given tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    from corpuslens.llm.licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"), resolve=True)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    from corpuslens.llm.decontam import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    from corpuslens.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.filter(~held_out(docs))))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    from corpuslens.llm.secrets import as_text, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    from corpuslens.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), path, with_ids=False)


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, by word pairs."""
    from corpuslens.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to packages and read back."""
    from corpuslens.llm.warc import read_packages, write_packages

    records = read_packages(write_packages(table(spark, sf_dir, "pages")))
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLES["op8_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest,
         max(page_id) OVER (PARTITION BY sha1(payload)) AS last
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that repeat anywhere in the documents, removed."""
    from corpuslens.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, equal texts together."""
    from corpuslens.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and likelihood ratio of all documents; the target are those of quality 1."""
    from corpuslens.llm.quality import judge

    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return judge(table(spark, sf_dir, "documents"), trusted)


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at the least cost."""
    from corpuslens.llm.repair import damage, repair

    rows = table(spark, sf_dir, "conversations")
    found = repair(damage(rows)).report.withColumn("_known", F.lit(True))
    every = rows.select("conv_id").distinct()
    joined = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    count = lambda name: F.coalesce(f"f.{name}", F.lit(0)).cast("long").alias(name)
    return joined.select(
        "e.conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("f.audit", F.lit("")).alias("audit"),
        F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of those that are not held out."""
    from corpuslens.llm.nbsvm import THRESHOLD, held_out, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels.filter(~held_out(labels)), label_col="quality"))
    return found.select(
        "doc_id", held_out(found).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


@query
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all."""
    from corpuslens.llm.hardneg import mine, quantised

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings"), label=moved)
    return mine(rows, rows.filter("id % 100 = 0"))


ORACLES["op11_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
