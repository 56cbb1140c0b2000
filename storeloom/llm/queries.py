"""The registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.llm import bpe, oracles
from storeloom.llm.common import table
from storeloom.llm.conversation_repair import repair
from storeloom.llm.licenses import scan_licenses
from storeloom.llm.line_dedup import line_dedup
from storeloom.llm.merkle import edit_trace
from storeloom.llm.mixing import mix
from storeloom.llm.ordinal import grade_documents
from storeloom.llm.phrase_index import contamination
from storeloom.llm.quality_forest import quality_rules
from storeloom.llm.simhash import near_duplicates
from storeloom.llm.suffix_dedup import substring_dedup
from storeloom.llm.warc import read_archives, write_archives
from storeloom.llm.whitening import whiten
from storeloom.plans.registry import Query
from storeloom.session import work_folder

REGISTRY: dict[str, Query] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> str:
    """The installed rank file of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(name: str, oracle: str | None = None):
    def register(run):
        REGISTRY[name] = Query(run, oracle)
        return run

    return register


@query("op1_license_scan", oracles.license_scan())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_merkle_fingerprint", oracles.MERKLE)
def merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_trace(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", oracles.LINE_DEDUP)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_soft_mixing")
def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_quality_rules")
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary())
    return bpe.token_digests(bpe.round_trip(table(spark, sf_dir, "documents"), ranks))


@query("op10_ordinal_quality")
def ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_documents(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_warc_segments", oracles.WARC)
def warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"
    )


@query("op11_phrase_index", oracles.PHRASES)
def phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_item_ids").cast("long").alias("n_near_items"),
    )


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).select(
        "vec_id",
        "component",
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of their id and turn; nulls are one space."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        "conv_id",
        "turn",
        (fault != 0).alias("kept"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault.isin(0, 1), "")
        .when(fault == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations"))
    return repair(turns, kept=F.col("kept")).report
