"""Queries of the training-text problems over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import cooccur, handwritten, leaks, mixing, names, splitting
from terrane.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.found(table(spark, sf, "file_metrics"), table(spark, sf, "file_heads"))


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.kind(handwritten.scored(table(spark, sf, "file_metrics"), table(spark, sf, "file_heads")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.found(table(spark, sf, "ownership"), table(spark, sf, "file_metrics"))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.members(table(spark, sf, "ownership"), table(spark, sf, "file_metrics"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccur.found(table(spark, sf, "commits"))


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    got = cooccur.coupled(table(spark, sf, "commits"))
    return got.selectExpr("grp AS repo", "a", "b", "shared", "a_revs", "b_revs", "round(degree, 4) AS degree", "round(lift, 4) AS lift")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.found(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.removal_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(table(spark, sf, "documents"), table(spark, sf, "size_limits"))


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each target keeps its repeats and meets its share; SQL says all do.

    A budget beyond the remainder must be met to a token and the share to a thousandth; a smaller one is met as nearly as its few
    documents allow, which a test holds to all subsets, and must not be exceeded.
    """
    _, report = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    most = table(spark, sf, "mix_targets").groupBy("source").agg(F.min("max_repeats").alias("most"))
    meets = ((F.col("budget") <= mixing.REMAINDER) & (F.col("gap") >= 0)) | ((F.abs(F.col("actual_share") - F.col("target_share")) <= 0.001) & (F.col("gap").between(0, 1)))
    return report.join(most, "source").select("source", (F.col("most_uses") <= F.coalesce("most", F.lit(0))).alias("within_repeats"), meets.alias("meets_share"))


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pieces of each document hold their place, join without a gap to the whole text, and keep the limit; SQL says all do."""
    docs, limits = table(spark, sf, "documents"), table(spark, sf, "size_limits")
    rule = limits.groupBy("source").agg(F.min("max_tokens").alias("most"))
    other = rule.where("source IS NULL").select(F.col("most").alias("other"))
    own = docs.where("text IS NOT NULL").select("doc_id", "source", F.col("text").alias("whole")).join(rule, "source", "left").join(F.broadcast(other.agg(F.max("other").alias("other"))))
    p = splitting.split(docs, limits).join(own.select("doc_id", "whole", F.coalesce("most", "other").alias("most")), "doc_id")
    fits = (F.col("text") == F.substring("whole", F.col("first_char") + 1, F.col("last_char") - F.col("first_char"))) & (F.coalesce(F.col("n_tokens") <= F.col("most"), F.lit(True)))
    per = p.groupBy("doc_id").agg(
        F.max(F.length("whole")).alias("n_chars"), F.bool_and(fits).alias("fits"), F.array_sort(F.collect_list(F.struct("piece", "first_char", "last_char"))).alias("ps")
    )
    last = F.element_at("ps", -1)
    joined = F.forall(F.sequence(F.lit(1), F.size("ps")), lambda i: F.element_at("ps", i)["first_char"] <= F.when(i > 1, F.element_at("ps", F.greatest(i - 1, F.lit(1)))["last_char"]).otherwise(0))
    return per.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "fits", (joined & (last["last_char"] == F.col("n_chars")) & (last["piece"] + 1 == F.size("ps"))).alias("whole"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p5_found, p5_entities, p6_found, p6_scores, p7_found, p7_spans, p8_selection, p8_report, p8_checked, p9_pieces, p9_checked)}
#: What the properties of a mix and of a split must be.
CHECKED = {
    "p8_checked": "SELECT DISTINCT source, true AS within_repeats, true AS meets_share FROM mix_targets WHERE source IS NOT NULL",
    "p9_checked": "SELECT doc_id, length(text) AS n_chars, true AS fits, true AS whole FROM documents WHERE text IS NOT NULL",
}
ORACLE: dict[str, str] = {"p6_found": cooccur.FOUND_SQL, "p6_scores": cooccur.SCORES_SQL, **CHECKED}
