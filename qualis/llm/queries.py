"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qualis.llm import bpe, collocations, decontaminate, linededup, lmscore, pii, quality, runs, simhash, substrings, tokenfile, topk, toxicity
from qualis.llm.common import key_text, load

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_text(load(spark, sf_dir, "documents"))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op3_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.digest(documents(spark, sf_dir))


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(load(spark, sf_dir, "embeddings"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op7_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(documents(spark, sf_dir), VOCABULARY)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), VOCABULARY)


def op9_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op10_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op11_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(documents(spark, sf_dir))


def op12_hat_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(load(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_simhash_pigeonring": op2_simhash_pigeonring,
    "op3_prefix_filter": op3_prefix_filter,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op5_block_topk": op5_block_topk,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_bitplane_tokens": op7_bitplane_tokens,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_clause_grammar": op9_clause_grammar,
    "op10_nb_svm": op10_nb_svm,
    "op11_sync_runs": op11_sync_runs,
    "op12_hat_trie": op12_hat_trie,
    "op13_line_dedup": op13_line_dedup,
}

#: DuckDB SQL where SQL can express the query.
ORACLES: dict[str, str] = {
    "op3_prefix_filter": decontaminate.ORACLE,
    "op4_stupid_backoff": lmscore.ORACLE,
    "op5_block_topk": topk.ORACLE,
    "op12_hat_trie": collocations.ORACLE,
    "op13_line_dedup": linededup.ORACLE,
}
