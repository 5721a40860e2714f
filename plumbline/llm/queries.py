"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import read_table


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.hmm import score_corpus

    return score_corpus(read_table(spark, sf_dir, "documents"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.bpe import digests, encode

    return digests(encode(read_table(spark, sf_dir, "documents")))


def op3_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.warc import round_trip

    return round_trip(read_table(spark, sf_dir, "pages"))


def op4_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.rules import apply_rules, learn_rules

    docs = read_table(spark, sf_dir, "documents")
    return apply_rules(docs, learn_rules(docs, read_table(spark, sf_dir, "labels")))


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.toxicity import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontaminate import report

    return report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import scratch_dir
    from plumbline.llm.rollup import replay

    return replay(read_table(spark, sf_dir, "documents"), scratch_dir(spark, "rollup")).totals()


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.attention import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.licences import document_paths, scan

    return scan(document_paths(read_table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.negatives import hard_negatives

    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.linededup import report

    return report(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def llm_oracles() -> dict[str, str]:
    from plumbline.llm import decontaminate, licences, linededup, neardup, negatives, rollup, trie, warc

    return {
        "op3_warc_source": warc.ORACLE,
        "op6_benchmark_decontamination": decontaminate.ORACLE,
        "op7_token_rollup": rollup.ORACLE,
        "op9_minmax_near_duplicates": neardup.ORACLE,
        "op10_licence_scan": licences.ORACLE,
        "op11_hard_negatives": negatives.ORACLE,
        "op12_prefix_trie": trie.ORACLE,
        "op13_line_dedup": linededup.ORACLE,
    }
