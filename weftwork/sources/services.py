"""Optional services: a grammar checker over HTTP and a local translator; both are off unless asked for."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Languages as the checker names them.
CHECKED = {"en": "en-US", "ru": "ru-RU", "nl": "nl"}


def grammar_issues(pairs: DataFrame, url: str, timeout: float = 5.0) -> DataFrame:
    """(id, code, severity, detail) of what a LanguageTool server at ``url`` says of the targets; errors give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, text, lang in zip(x.id, x.target, x.tgt_lang):
                if lang not in CHECKED or not (text or "").strip():
                    continue
                data = urllib.parse.urlencode({"text": text, "language": CHECKED[lang]}).encode()
                try:
                    with urllib.request.urlopen(f"{url.rstrip('/')}/v2/check", data, timeout) as answer:
                        found = json.load(answer).get("matches", [])
                except (OSError, ValueError):
                    continue
                rows += [(key, "lt_" + m.get("rule", {}).get("id", "").lower(), "warning", m.get("message", "")) for m in found]
            yield pd.DataFrame(rows, columns=["id", "code", "severity", "detail"])

    return pairs.select("id", "target", "tgt_lang").mapInPandas(run, "id long, code string, severity string, detail string")


def machine_translations(asked: DataFrame) -> DataFrame:
    """(src_lang, tgt_lang, plain, text) by argostranslate, if that package and a model for the pair are installed."""
    import importlib.util

    if importlib.util.find_spec("argostranslate") is None:
        raise ImportError("machine translation needs argostranslate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from argostranslate import translate

        for x in batches:
            rows = []
            for src, tgt, text in zip(x.src_lang, x.tgt_lang, x.plain):
                try:
                    rows.append((src, tgt, text, translate.translate(text, src, tgt)))
                except Exception:  # noqa: BLE001, S112 - no model for the pair
                    continue
            yield pd.DataFrame(rows, columns=["src_lang", "tgt_lang", "plain", "text"])

    return asked.select("src_lang", "tgt_lang", "plain").mapInPandas(run, "src_lang string, tgt_lang string, plain string, text string")
