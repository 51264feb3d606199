"""The queries of the operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, spread
from tessera.llm.decontaminate import find_leaks
from tessera.llm.fingerprints import fingerprint_neighbours
from tessera.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from tessera.llm.oracles import OP1, OP3, OP4, op6
from tessera.llm.quality import quality_scores
from tessera.llm.secret_scan import secret_digest
from tessera.llm.simhash import hex_fingerprint, simhash_components
from tessera.llm.source_mix import pareto_mix
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_counts import token_counts
from tessera.llm.url_filter import Rule, judge_urls, labelled_outcomes

#: The fixed rules of the url query.
URL_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def vocabulary(name: str) -> str:
    """A file of the installed public vocabularies, or of the folder named by TESSERA_TOKENIZERS."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(read_table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"), limit=512)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, labelled_outcomes(pages, read_table(spark, sf_dir, "labels")), URL_RULES, limit=0.5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spread(read_table(spark, sf_dir, "documents")), threshold=0.8)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), cut=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_source_mix": op7_source_mix,
    "op8_fingerprints": op8_fingerprints,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}
#: The other operators' queries have parts that SQL has no means for (tokenizers, XXH64, sketches, fitted models, draws by
#: hash, entropy windows): tests/llm compares them with brute-force versions.
ORACLES: dict[str, str] = {"op1_decontamination": OP1, "op3_substring_dedup": OP3, "op4_url_filter": OP4, "op6_license_scan": op6(TEMPLATES, PHRASES)}
