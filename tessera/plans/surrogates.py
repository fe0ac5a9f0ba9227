"""Queries of boosted surrogates: a document's quality from simple measures of its text, with the
operators' own settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models
from .registry import Tables, query

SETTINGS = models.Settings()
FEATURES = ["length", "words", "digits", "upper", "lines"]


def measured(db: Tables) -> DataFrame:
    """Labelled documents with shares and counts of their characters; of an empty text, zeros. What is rare is taken out, what is left is counted."""
    text = F.coalesce("text", F.lit(""))
    share = lambda pattern: F.coalesce(F.try_divide((F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double"), F.length(text)), F.lit(0.0))
    features = db.documents.select("doc_id", "source", F.length(text).cast("double").alias("length"), F.size(F.split(text, r"\s+")).cast("double").alias("words"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"), F.size(F.split(text, "\n")).cast("double").alias("lines"))
    return features.join(db.labels.select("doc_id", "quality"), "doc_id").select("source", "quality", *FEATURES)  # texts are not shuffled


@query(None)
def surrogate_folds(db: Tables) -> DataFrame:
    return models.cross_validate(measured(db), FEATURES, "quality", "source", 5, SETTINGS)


@query(None)
def surrogate_ranking(db: Tables) -> DataFrame:
    return models.ranking(measured(db), FEATURES, "quality", SETTINGS)


@query(None)
def surrogate_stability(db: Tables) -> DataFrame:
    """Over 30 resamples of sources; among the first two, as the first five are all features."""
    return models.stability(measured(db), FEATURES, "quality", "source", 30, 2, SETTINGS)


@query(None)
def mediation_test(db: Tables) -> DataFrame:
    return models.mediation(measured(db), ["length", "digits"], ["words", "lines"], ["length"], "quality", SETTINGS)
