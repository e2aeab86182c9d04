"""Uploaded documents by their extension: XLIFF as it is, text and PDF by their sentences."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.sources import plain, xliff

_XLIFF, _TEXT, _PDF = r"(?i)\.xlf$|\.xliff$", r"(?i)\.txt$", r"(?i)\.pdf$"


def _refused(when: Column, why: str) -> Column:
    """An error for the document in which ``when`` holds, else its id."""
    return F.when(when, F.raise_error(F.concat(F.lit(f"{why}: "), F.coalesce("name", F.lit("?"))))).otherwise(F.col("id"))


def units(documents: DataFrame) -> DataFrame:
    """(id, seq, unit_id, source, target, state) of (id, name, content as bytes).

    Other extensions, PDF without the package that reads it, unreadable PDF and documents that give no unit are errors. A unit
    is translated only if it has a target.
    """
    named = lambda pattern: F.coalesce(F.col("name").rlike(pattern), F.lit(False))
    checked = documents.select(_refused(~(named(_XLIFF) | named(_TEXT) | named(_PDF)), "unknown kind of document").alias("id"), "name", "content")
    text = checked.select("id", "name", F.make_valid_utf8(F.col("content").cast("string")).alias("original"))
    found = xliff.units(text.where(named(_XLIFF))).select(F.col("file_id").alias("id"), "seq", "unit_id", "source", "target", F.when(F.col("target") != "", F.col("state")).otherwise("new").alias("state"))
    if importlib.util.find_spec("pypdf") is None:
        pdf = checked.where(named(_PDF)).select(_refused(F.lit(True), "reading PDF needs pypdf").alias("id"), F.lit("").alias("text"))
    else:
        read = plain.pdf_texts(checked.where(named(_PDF)), "id").withColumn("name", F.col("error"))
        pdf = read.select(_refused(F.col("error").isNotNull(), "unreadable PDF").alias("id"), "text")
    sents = plain.sentences(text.where(named(_TEXT)).select("id", F.col("original").alias("text")).unionByName(pdf))
    escaped = F.replace(F.replace(F.replace(F.col("source"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = found.unionByName(sents.select("id", "seq", F.col("seq").cast("string").alias("unit_id"), escaped.alias("source"), F.lit("").alias("target"), F.lit("new").alias("state")))
    whole = checked.select("id", "name").join(rows, "id", "left")
    return whole.select(_refused(F.col("seq").isNull(), "no units in document").alias("id"), "seq", "unit_id", "source", "target", "state")
