"""The operators over their whole tables, one query each."""

import public_tokenizers

from pyspark.sql import functions as F

from . import (
    best_fit_packing, cross_tokenizer_alignment, decontamination, hidden_markov, hilbert_sharding, language_id, nearest_neighbours,
    ngram_jaccard_join, packed_matrices, periodic_runs, pii, source_mixing, url_filter,
)
from .common import held_out, table
from .oracle import ORACLE  # noqa: F401  (part of what the entry point reads)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark, sf_dir):
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_ngram_jaccard_join(spark, sf_dir):
    found = ngram_jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_contextual_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.learn(docs))


def op4_hidden_markov_scoring(spark, sf_dir):
    return hidden_markov.score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op5_packed_matrices(spark, sf_dir):
    return packed_matrices.matrices(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_hilbert_sharding(spark, sf_dir):
    return hilbert_sharding.shard(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    return language_id.identify(docs, language_id.learn(docs.filter("NOT held_out")), ("doc_id", "held_out"))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return cross_tokenizer_alignment.report(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark, sf_dir):
    return source_mixing.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_ngram_jaccard_join, op3_contextual_pii, op4_hidden_markov_scoring,
    op5_packed_matrices, op6_hilbert_sharding, op7_benchmark_decontamination, op8_nearest_neighbours, op9_url_filter, op10_language_id,
    op11_cross_tokenizer_alignment, op12_periodic_runs, op13_source_mixing,
)}
