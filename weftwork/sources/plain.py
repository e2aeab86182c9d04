"""Plain text and PDF documents in, plain text out."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.text import paragraphs, split_plain_sentences


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files, read as UTF-8; what is none becomes U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def sentences(documents: DataFrame) -> DataFrame:
    """(id, seq, source): sentences of (id, text) in order, paragraph by paragraph."""
    each = F.flatten(F.transform(paragraphs(F.col("text")), split_plain_sentences))
    return documents.select("id", F.posexplode(each).alias("place", "source")).select("id", (F.col("place") + 1).alias("seq"), "source")


def exported_parts(segments: DataFrame, size: int = 10_000) -> DataFrame:
    """(file_id, part, content): a line for each segment in order, its target, or its source where there is none.

    A part holds the lines of ``size`` places, so that a file of many segments is many rows.
    """
    text = F.coalesce(F.nullif(F.col("target"), F.lit("")), F.col("source"), F.lit(""))
    lines = F.array_sort(F.collect_list(F.struct("seq", "id", text.alias("text"))))
    part = F.floor(F.coalesce("seq", F.lit(0)) / size).cast("int").alias("part")
    return segments.groupBy("file_id", part).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("content"))


def exported(segments: DataFrame) -> DataFrame:
    """(file_id, content): the parts of each file as one text; for files that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("part", "content")))
    return exported_parts(segments).groupBy("file_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("content"))


def _needs_pypdf() -> None:
    if importlib.util.find_spec("pypdf") is None:
        raise ImportError("reading PDF needs pypdf")


def pdf_texts(documents: DataFrame, key: str) -> DataFrame:
    """(key, text, error) of (key, content as bytes): pages with text, joined by blank lines. Needs the optional package pypdf."""
    _needs_pypdf()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for x in batches:
            rows = []
            for p, content in zip(x[key], x.content):
                try:
                    reader = PdfReader(io.BytesIO(content))
                    if reader.is_encrypted:
                        reader.decrypt("")
                    text = "\n\n".join(t for t in ((page.extract_text() or "").strip() for page in reader.pages) if t)
                    rows.append((p, text or None, None if text else "no text"))
                except Exception as e:  # noqa: BLE001 - whatever a broken file raises is its error
                    rows.append((p, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[key, "text", "error"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "content").mapInPandas(run, f"{key} {kind}, text string, error string")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of PDF files."""
    _needs_pypdf()
    return pdf_texts(spark.read.format("binaryFile").load(path), "path")
