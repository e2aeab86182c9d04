"""TMX 1.4: pairs of documents held in a column, and a document's lines from a memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import collapse, norm_lang
from weftwork.session import salted_join
from weftwork.sources.markup import run


def base(lang: str | None) -> str:
    return (lang or "").strip().lower().replace("_", "-").split("-")[0]


class _Variants:
    """(unit, place, language, text) of the variants of a document, in order; inline tags are left out and their text kept."""

    def __init__(self) -> None:
        self.at = self.unit = self.place = 0
        self.lang: str | None = None
        self.found: list[tuple[int, int, str, str]] = []
        self.path: list[str] = []
        self.parts: list[str] | None = None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self.path.append(name)
        if name == "tu":
            self.unit += 1
        elif name == "tuv":
            self.lang, self.place = base(attributes.get("lang")), self.place + 1
        elif name == "seg" and self.path[-2:-1] == ["tuv"] and self.lang is not None:
            self.parts = []

    def end(self, name: str) -> None:
        self.path.pop()
        if name == "seg" and self.parts is not None and self.path[-1:] == ["tuv"]:
            self.found.append((self.unit, self.place, self.lang or "", "".join(self.parts)))
            self.parts, self.lang = None, None

    def text(self, data: str) -> None:
        if self.parts is not None:
            self.parts.append(data)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for k, doc, a, b in zip(x.doc_id, x.content, x.src_lang, x.tgt_lang):
            reader = _Variants()
            if run(doc, reader):
                rows += [(k, base(a), base(b), *v) for v in reader.found]
        yield pd.DataFrame(rows, columns=["doc_id", "src_lang", "tgt_lang", "place", "variant", "lang", "text"])


def variants(documents: DataFrame) -> DataFrame:
    """(doc_id, src_lang, tgt_lang, place, variant, lang, text): a row for each language variant of each unit, with the pair asked for."""
    found = documents.select("doc_id", "content", "src_lang", "tgt_lang").mapInPandas(_scan, "doc_id long, src_lang string, tgt_lang string, place int, variant int, lang string, text string")
    return found.withColumn("text", collapse(F.col("text"))).where("lang <> '' and text <> ''")


def pairs(documents: DataFrame, both_directions: bool = False) -> DataFrame:
    """(doc_id, src_lang, tgt_lang, place, source, target) of (doc_id, content, src_lang, tgt_lang).

    Units that hold both languages, whichever way round; the first variant of a language counts.
    """
    first = lambda lang: F.min_by(F.when(F.col("lang") == F.col(lang), F.col("text")), F.when(F.col("lang") == F.col(lang), F.col("variant")))
    found = variants(documents).groupBy("doc_id", "src_lang", "tgt_lang", "place").agg(first("src_lang").alias("source"), first("tgt_lang").alias("target"))
    found = found.where("source is not null and target is not null")
    if not both_directions:
        return found
    return found.unionByName(found.select("doc_id", F.col("tgt_lang").alias("src_lang"), F.col("src_lang").alias("tgt_lang"), "place", F.col("target").alias("source"), F.col("source").alias("target")))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unit_lines(memory: DataFrame) -> DataFrame:
    """(id, src_lang, tgt_lang, line): a tu element for each unit; with head() and FOOT around a pair's lines a document."""
    src, tgt = norm_lang(F.col("src_lang")), norm_lang(F.col("tgt_lang"))
    tuv = lambda lang, text: F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg>'), _escaped(text), F.lit("</seg></tuv>"))
    line = F.concat(F.lit("<tu>"), tuv(src, F.col("source")), tuv(tgt, F.col("target")), F.lit("</tu>"))
    return memory.where("source is not null and target is not null").select("id", src.alias("src_lang"), tgt.alias("tgt_lang"), line.alias("line"))


FOOT = "</body></tmx>"


def head(src: str, created: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header creationtool="weftwork" creationtoolversion="1" segtype="sentence" o-tmf="none" adminlang="en" srclang="{src}" datatype="plaintext" creationdate="{created}"/><body>'


def documents(memory: DataFrame, created: str, size: int = 50_000) -> DataFrame:
    """(src_lang, tgt_lang, part, content): whole TMX documents of about ``size`` units each; a pair of many units has many parts.

    ``created`` is the documents' time, as 20240131T120000Z.
    """
    lines = unit_lines(memory)
    counts = lines.groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / size))
    spread = salted_join(lines, counts, ["src_lang", "tgt_lang"], ["id"]).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    whole = spread.groupBy("src_lang", "tgt_lang", "part").agg(body.alias("body"))
    before, after = head("\x00", created).split("\x00")
    return whole.select("src_lang", "tgt_lang", "part", F.concat(F.lit(before), "src_lang", F.lit(after + "\n"), "body", F.lit("\n" + FOOT)).alias("content"))


def write(memory: DataFrame, folder: str, src: str, tgt: str, created: str, size: int = 50_000) -> None:
    """A pair's units as TMX documents, each a file of its own, with header and footer."""
    own = memory.where((norm_lang(F.col("src_lang")) == base(src)) & (norm_lang(F.col("tgt_lang")) == base(tgt)))
    whole = documents(own, created, size)
    # one document is one row, and a file holds the rows of one part only
    whole.select("part", "content").write.mode("overwrite").partitionBy("part").text(folder, lineSep="\n")
