"""Queries over the documents and embeddings tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import forest, hosts, infilling, langid, licences, manifest, mixing, passages, topk, winnowing
from . import toxicity as toxic
from .common import table
from .transducer import encode_decode
from .wavelet import token_shards

TOKENIZER = "byte_bpe_50k.json"


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(table(spark, sf_dir, "documents"))


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_licence_scan": licence_scan,
    "op2_wavelet_shards": shards,
    "op3_minhash_forest": near,
    "op4_bpe_transducer": bpe,
    "op5_pareto_mix": mixture,
    "op6_host_rules": host_rules,
    "op7_norm_sorted_topk": nearest,
    "op8_fixed_block_anchors": substrings,
    "op9_toxicity_trees": toxicity,
    "op10_cross_parsing": languages,
    "op11_winnowing": decontamination,
    "op12_merkle_witnesses": witnesses,
    "op13_fill_in_middle": infill,
}
SQL: dict[str, str] = {
    "op3_minhash_forest": forest.SQL,
    "op5_pareto_mix": mixing.SQL,
    "op6_host_rules": hosts.SQL,
    "op7_norm_sorted_topk": topk.SQL,
    "op8_fixed_block_anchors": passages.SQL,
    "op11_winnowing": winnowing.SQL,
    "op12_merkle_witnesses": manifest.SQL,
    "op13_fill_in_middle": infilling.SQL,
}
