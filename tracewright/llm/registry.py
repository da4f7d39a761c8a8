"""The queries op1_ .. op13_ and the pipeline, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tracewright.llm import alignment, embedding_dedup, html_extract, language_crf, mixing, near_dedup, packing, quality_model, quality_rules, spelling, suffix_dedup, token_store, warc
from tracewright.llm.common import documents, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_by_lines(documents(spark, sf_dir))


SQL["op1_quality_rules"] = quality_rules.SQL


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, _ = token_store.write(documents(spark, sf_dir))
    return token_store.read(spark, uri)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("given")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, _ = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(spark, uri)


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(documents(spark, sf_dir)).drop("class_id")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.labelled(documents(spark, sf_dir))


@query
def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
