"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter and read by each worker."""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files, and the one that is used.
FOLDER = os.environ.get("WEFTWORK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that pre-splits texts, where the folder's package states none.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    try:
        pattern = importlib.import_module("public_tokenizers").PATTERN
    except (ImportError, AttributeError):
        pattern = PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """The columns ``keep`` and n_tokens of each document with a text; an empty text has none."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for x in batches:
            n = pa.array([len(enc.encode_ordinary(t)) for t in x[text].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[x[c] for c in keep], n], names=[*keep, "n_tokens"])

    return docs.where(docs[text].isNotNull()).select(*keep, text).mapInArrow(run, ", ".join([*fields, "n_tokens long"]))
