"""Queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstat.llm import merkle_log, minhash_join, mixing, nn_descent, secrets_scan, tool_calls, warc_zstd
from loomstat.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {"op2_source_mixing": mixing.ORACLE, "op3_secret_scan": secrets_scan.ORACLE,
                           "op6_nn_descent": nn_descent.ORACLE, "op7_tool_call_linking": tool_calls.ORACLE, "op8_minhash_near_dedup": minhash_join.ORACLE,
                           "op12_merkle_manifest": merkle_log.ORACLE, "op13_warc_zstd": warc_zstd.ORACLE}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    from loomstat.llm.minhash_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    from loomstat.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, owners being the sources and repositories the documents."""
    from loomstat.llm.secrets_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    from loomstat.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    import public_tokenizers

    from loomstat.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of all documents."""
    from loomstat.llm.hmm_lm import score

    return score(table(spark, sf_dir, "documents"))


@query
def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked calls in canonical JSON."""
    from loomstat.llm.tool_calls import exchanges, link

    return link(*exchanges(table(spark, sf_dir, "conversations")))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from loomstat.llm.tag_paths import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th embedding."""
    from pyspark.sql import functions as F

    from loomstat.llm.adaptive_scan import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    from loomstat.llm.nn_descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, every tenth of which repeats itself."""
    from loomstat.llm.periodic_runs import digest, periodic_runs, planted

    return digest(periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents, a third of which are checked with altered texts."""
    from loomstat.llm.merkle_log import verified

    return verified(table(spark, sf_dir, "documents"))


@query
def op13_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    from loomstat.llm.warc_zstd import archived, summary

    return summary(archived(table(spark, sf_dir, "pages")))
