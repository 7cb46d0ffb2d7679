"""Queries of remedies for a rare class."""

from __future__ import annotations

from string import ascii_letters, ascii_uppercase, digits

from pyspark.sql import functions as F

from tallyloom.operators import imbalance as I
from tallyloom.operators.cleaning import character_counts

from .base import r, table
from .registry import query

CLASSES = {"digits": digits, "capitals": ascii_uppercase, "spaces": " \n", "plain": ascii_letters + digits + " \n"}


def _compared(spark, sf_dir, model: str):
    """Low quality as the rare label, told from measures of whole texts."""
    d = character_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", CLASSES, "n").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda c: F.col(c) / F.greatest(F.lit(1), F.col("n"))
    features = F.array(F.log1p("n"), share("digits"), share("capitals"), share("spaces"), (F.col("n") - F.col("plain")) / F.greatest(F.lit(1), F.col("n")))
    d = d.select("doc_id", features.alias("vec"), (F.col("quality") == 0).cast("int").alias("y"))
    s = I.paired_remedies(I.resampled_scores(d, "doc_id", "vec", "y", 4, 0.5, "imbalance", model=model))
    return s.select("method", "reps", *[r(c).alias(c) for c in s.columns if c not in ("method", "reps")])


@query()
def imbalance_comparison(spark, sf_dir):
    return _compared(spark, sf_dir, "logistic")


@query()
def imbalance_comparison_trees(spark, sf_dir):
    return _compared(spark, sf_dir, "boosted")
