"""Registered queries of the corpus operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import ORACLE as CENTROID_SQL
from .centroids import centroid_clusters
from .code_search import ORACLE as SEARCH_SQL
from .code_search import nearest_codes
from .collocations import ORACLE as COLLOCATION_SQL
from .collocations import collocations
from .common import table
from .language_mixture import languages
from .near_dedup import near_duplicates
from .packing import packed
from .preferences import ORACLE as PREFERENCE_SQL
from .preferences import echo_pairs, preference_segments
from .quality_classifier import quality_scores
from .quality_rules import ORACLE as RULES_SQL
from .quality_rules import quality_rules
from .sharding import shards
from .source_mixing import ORACLE as MIXTURE_SQL
from .source_mixing import mixture
from .suffix_dedup import repeat_report
from .url_rules import ORACLE as URL_SQL
from .url_rules import url_verdicts


def op1_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture as text: languages and shares, largest first."""
    found = languages(table(spark, sf_dir, "documents"))
    shares = F.transform("proportions", lambda p: F.round(p, 4).cast("string"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"),
                        F.array_join(shares, ",").alias("proportions"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made from all conversations: each is preferred to itself with its last answer replaced by an echo."""
    return preference_segments(*echo_pairs(table(spark, sf_dir, "conversations")))


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_deep_shallow_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_codes(table(spark, sf_dir, "embeddings"))


def op8_low_discrepancy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op9_longest_first_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op10_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_collocation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_odd_sketch_near_dedup": op1_odd_sketch_near_dedup,
    "op2_language_mixture": op2_language_mixture,
    "op3_preference_format": op3_preference_format,
    "op4_rule_cascade": op4_rule_cascade,
    "op5_deep_shallow_suffix_dedup": op5_deep_shallow_suffix_dedup,
    "op6_quadratic_quality": op6_quadratic_quality,
    "op7_multi_index_search": op7_multi_index_search,
    "op8_low_discrepancy_mixing": op8_low_discrepancy_mixing,
    "op9_longest_first_sharding": op9_longest_first_sharding,
    "op10_least_squares_packing": op10_least_squares_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_collocation_graph": op12_collocation_graph,
    "op13_association_url_filter": op13_association_url_filter,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_preference_format": PREFERENCE_SQL,
    "op4_rule_cascade": RULES_SQL,
    "op7_multi_index_search": SEARCH_SQL,
    "op8_low_discrepancy_mixing": MIXTURE_SQL,
    "op11_centroid_clustering": CENTROID_SQL,
    "op12_collocation_graph": COLLOCATION_SQL,
    "op13_association_url_filter": URL_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
