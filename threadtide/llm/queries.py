"""The operators of this package bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from threadtide.llm import align, chunked, compact, hostarray, idfile, jaccard, lattice, lempelziv, licenses, prefixtrie, tiling, toxicity, urlfilter, viterbi
from threadtide.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from threadtide.llm.shared import scratch


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.load_model(spark, documents, sf_dir)
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode(table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find(table(spark, sf_dir, "documents"), tiling.item_blocks(table(spark, sf_dir, "benchmark")))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.report(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_url_filters", urlfilter.oracle())
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostarray.extract(table(spark, sf_dir, "pages"))


@query("op9_license_scans", licenses.oracle())
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", licenses.document_path())


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice.score(table(spark, sf_dir, "documents"), ~lattice.held_out())
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "pieces_score")


@query("op12_token_ids")
def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, path = table(spark, sf_dir, "documents"), scratch(spark, "ids")
    idfile.write(documents, path, chunked.definition())
    places = idfile.look(documents, path).unionByName(idfile.unkeyed(spark, path))
    return idfile.read(places, path).withColumnRenamed("key", "doc_id")


@query("op13_prefix_trie", prefixtrie.oracle())
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), chunked.definition(), chunked.model())
