"""Registered queries of the operators, with the parameters production runs use."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from canasta.llm import (
    collocations,
    decontamination,
    language,
    licenses,
    mixing,
    near,
    oracles,
    recompression,
    sharding,
    spelling,
    suffixes,
    syncmers,
    tokens,
    urls,
)
from canasta.llm.shared import table

#: The vocabulary file; a path that every executor can read.
VOCABULARY = "byte_bpe_50k.json"


def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, sharding.balanced(40))


def op2_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return tokens.encoded_documents(docs, public_tokenizers.path(VOCABULARY))


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, benchmark).drop("mark")


def op5_suffixes(spark, sf_dir):
    kept = suffixes.kept_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark")


def op7_licenses(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op8_recompression(spark, sf_dir):
    kept = recompression.kept_words(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_words", "n_removed", digest)


def op9_syncmers(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op10_near(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_spelling(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).drop("step")


def registered() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_sharding,
            op2_tokens,
            op3_language,
            op4_decontamination,
            op5_suffixes,
            op6_mixing,
            op7_licenses,
            op8_recompression,
            op9_syncmers,
            op10_near,
            op11_spelling,
            op12_collocations,
            op13_urls,
        )
    }


ORACLES = {
    "op5_suffixes": oracles.OP5,
    "op8_recompression": oracles.OP8,
    "op11_spelling": oracles.OP11,
    "op12_collocations": oracles.OP12,
    "op13_urls": oracles.OP13,
}
