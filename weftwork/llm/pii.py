"""Problem 9: personal data in free text, found and replaced by typed placeholders.

Method as named: a character-level bidirectional LSTM with CRF transitions, in numpy (``pii_training`` trains it from
labelled spans). A text is read in overlapping windows; each character takes its scores from the window in which it lies
deepest, and one Viterbi pass over the whole text reconciles them. What is found then gets an exact check: spans are widened
to the words or numbers they cut, stripped of marks, and dropped if they can't be of their type (an email without a sign for
"at", a phone number with too few digits).

Cases: a null text has no findings and stays null; an empty one stays empty; texts of any length are read whole; repeated
ids are read each, findings are distinct; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TYPES = ("email", "phone", "id_number", "address", "name")
#: O, then B and I of each type.
LABELS = 1 + 2 * len(TYPES)
WINDOW, OVERLAP = 256, 64
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_ASCII = " \n\t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
_CLASSES = {c: i for i, c in enumerate("\0" + _ASCII + _LATIN + _CYRILLIC + "0“«—№°")}
#: Other letters, other marks.
_LETTER, _OTHER = len(_CLASSES), len(_CLASSES) + 1
#: Each class twice: small and capital.
SYMBOLS = 2 * (len(_CLASSES) + 2)


@lru_cache(1)
def _table() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    out = np.full(0x10000, 2 * _OTHER, np.uint16)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        low = c.lower()
        base = low if low in _CLASSES else unicodedata.normalize("NFD", low)[:1]
        if c.isdigit():
            k = _CLASSES["0"]
        elif c in "\r\xa0":
            k = _CLASSES[" "]
        elif c in "”„‘’":
            k = _CLASSES["“" if c in "”„" else "'"]
        elif c in "»":
            k = _CLASSES["«"]
        elif c in "–‑‐−":
            k = _CLASSES["-"]
        elif base in _CLASSES:
            k = _CLASSES[base]
        else:
            k = _LETTER if c.isalpha() else _OTHER
        out[cp] = 2 * k + c.isupper()
    return out


def symbols(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table()[np.minimum(cps, 0xFFFF)].astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@lru_cache(2)
def load_weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        w = {k: f[k].astype(np.float32) for k in f.files}
    for d in "fb":
        w[f"t{d}"] = w["emb"] @ w[f"wx{d}"] + w[f"bias{d}"]  # what each symbol adds to the gates
    return w


def run_lstm(gates: np.ndarray, ids: np.ndarray, wh: np.ndarray, reverse: bool) -> np.ndarray:
    """Hidden states (T, B, H) over symbols (T, B). Gates: input, forget, output, candidate."""
    T, B = ids.shape
    H = wh.shape[0]
    h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    out = np.empty((T, B, H), np.float32)
    for t in range(T - 1, -1, -1) if reverse else range(T):
        z = h @ wh
        z += gates[ids[t]]
        s = z[:, : 3 * H]
        s *= 0.5
        np.tanh(z, out=z)
        s *= 0.5
        s += 0.5
        live = (ids[t] != 0).astype(np.float32)[:, None]  # padding leaves the state alone
        c2 = z[:, H : 2 * H] * c + z[:, :H] * z[:, 3 * H :]
        c = c + live * (c2 - c)
        h = h + live * (z[:, 2 * H : 3 * H] * np.tanh(c2) - h)
        out[t] = h
    return out


def window_scores(w: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Label scores (T, B, LABELS) of windows (T, B)."""
    f = run_lstm(w["tf"], ids, w["whf"], False)
    b = run_lstm(w["tb"], ids, w["whb"], True)
    H = f.shape[2]
    return f @ w["out"][:H] + b @ w["out"][H:] + w["outb"]


def text_scores(w: dict[str, np.ndarray], texts: list[np.ndarray], batch: int = 384) -> list[np.ndarray]:
    """Label scores of each whole text, put together from its windows."""
    stride = WINDOW - OVERLAP
    jobs = []
    for n, s in enumerate(texts):
        starts = list(range(0, max(1, len(s) - OVERLAP), stride))
        jobs += [(n, a, min(len(s), a + WINDOW)) for a in starts]
    out = [np.zeros((len(s), LABELS), np.float32) for s in texts]
    jobs.sort(key=lambda j: j[1] - j[2])
    for at in range(0, len(jobs), batch):
        part = jobs[at : at + batch]
        T = part[0][2] - part[0][1]
        if not T:
            continue
        ids = np.zeros((T, len(part)), np.int64)
        for k, (n, a, b) in enumerate(part):
            ids[: b - a, k] = texts[n][a:b]
        scores = window_scores(w, ids)
        for k, (n, a, b) in enumerate(part):
            left = a + OVERLAP // 2 if a else 0
            right = b - OVERLAP // 2 if b < len(texts[n]) else b
            out[n][left:right] = scores[left - a : right - a, k]
    return out


def viterbi(w: dict[str, np.ndarray], scores: list[np.ndarray], group: int = 256) -> list[np.ndarray]:
    """The best label sequence of each text; texts of like length go together."""
    trans, start = w["trans"], w["start"]
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    at = 0
    while at < len(order) and len(scores[order[at]]):
        longest = len(scores[order[at]])
        size = max(1, min(group, 2_000_000 // longest))
        part = order[at : at + size]
        at += size
        T, B = longest, len(part)
        em = np.zeros((T, B, LABELS), np.float32)
        lengths = np.array([len(scores[i]) for i in part])
        for k, i in enumerate(part):
            em[: lengths[k], k] = scores[i]
        back = np.zeros((T, B, LABELS), np.int8)
        v = start + em[0]
        final = v.copy()
        for t in range(1, T):
            m = v[:, :, None] + trans[None]
            arg = m.argmax(1)
            back[t] = arg
            v = np.take_along_axis(m, arg[:, None, :], 1)[:, 0] + em[t]
            live = lengths > t
            final[live] = v[live]
        for k, i in enumerate(part):
            n = lengths[k]
            path = np.zeros(n, np.int8)
            y = int(final[k].argmax())
            for t in range(n - 1, -1, -1):
                path[t] = y
                y = int(back[t, k, y])
            out[i] = path
    return out


def spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the runs a label sequence holds."""
    out = []
    i, n = 0, len(path)
    marked = np.flatnonzero(path)
    k = 0
    while k < len(marked):
        i = int(marked[k])
        kind = (path[i] - 1) // 2
        j = i + 1
        while j < n and path[j] == 2 + 2 * kind:
            j += 1
        out.append((i, j, TYPES[kind]))
        while k < len(marked) and marked[k] < j:
            k += 1
    return out


# How the signs of an address are spelt out, in brackets or between spaces.
_AT = "at|ät|bij|apestaart|arobase|собака|собачка"
_DOT = "dot|punt|punkt|point|точка"
_SPELT_AT, _SPELT_DOT = rf"\s?[(\[{{<]\s?(?:{_AT})\s?[)\]}}>]\s?", rf"\s?[(\[{{<]\s?(?:{_DOT})\s?[)\]}}>]\s?"
#: An address; and one whose "at" is spelt out between spaces, which counts only where no other is.
_MAILS = (
    re.compile(rf"[\w.+-]+(?:\s?[@＠]\s?|{_SPELT_AT})[\w-]+(?:(?:{_SPELT_DOT}|\.| (?:{_DOT}) )[\w-]+)+", re.I),
    re.compile(rf"[\w.+-]+ (?:{_AT}) [\w-]+(?:(?: (?:{_DOT}) |\.)[\w-]+)+", re.I),
)
_EDGE = " \t\r\n,;:!?\"“”«»<>="


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact check of a finding: its proper ends, or None."""
    while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
        end += 1
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    piece = text[start:end]
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        # the tagger's span, widened to the address it lies in; without one it holds if it has a sign for "at"
        for mail in _MAILS:
            for m in mail.finditer(text, max(0, start - 64), min(len(text), end + 64)):
                if m.start() < end and m.end() > start:
                    return m.start(), m.end()
        signed = re.search(rf"[@＠]|(?<!\w)(?:{_AT})(?!\w)", piece, re.I)
        return (start, end) if signed and 0 < signed.start() and signed.end() < len(piece) else None
    if kind == "phone":
        if start and text[start - 1] in "+(" and digits:
            start -= 1
        while end > start and not text[end - 1].isdigit():
            end -= 1
        return (start, end) if digits >= 7 and digits <= 16 else None
    if kind == "id_number":
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not text[start].isalnum():
            start += 1
        return (start, end) if digits >= 4 else None
    if kind == "address":
        while end > start and text[end - 1] == "." and not text[start:end].endswith(" St."):
            end -= 1
        return (start, end) if digits and any(c.isalpha() for c in piece) else None
    if digits or not any(c.isalpha() for c in piece):
        return None
    if piece.endswith(".") and not (len(piece) > 2 and piece[-2].isupper() and not piece[-3].isalpha()):
        end -= 1
    return (start, end) if end - start > 1 else None


def find(texts: list[str], weights: str = str(WEIGHTS)) -> list[list[tuple[int, int, str]]]:
    """Findings of each text, in order, without overlaps."""
    w = load_weights(weights)
    paths = viterbi(w, text_scores(w, [symbols(t) for t in texts]))
    out = []
    for text, path in zip(texts, paths):
        found, reach = [], 0
        for a, b, kind in spans(path):
            ok = checked(text, a, b, kind)
            if ok and ok[0] >= reach:
                found.append((*ok, kind))
                reach = ok[1]
        out.append(found)
    return out


def _in_parts(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` characters, or one text."""
    a = size = 0
    for b, t in enumerate(texts):
        if b > a and size + len(t) > most:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder such as [EMAIL] for each finding."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, weights: str = str(WEIGHTS)) -> DataFrame:
    """(doc_id, pii_type, pii_text), distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts, ids, rows = x.text.tolist(), x.doc_id.tolist(), {}
            for a, b in _in_parts(texts):
                for i, found in zip(range(a, b), find(texts[a:b], weights)):
                    rows.update(dict.fromkeys((ids[i], kind, texts[i][s:e]) for s, e, kind in found))
            yield pd.DataFrame(list(rows), columns=["doc_id", "pii_type", "pii_text"])

    return _spread(docs).mapInPandas(run, "doc_id long, pii_type string, pii_text string").distinct()


def masked_documents(docs: DataFrame, weights: str = str(WEIGHTS)) -> DataFrame:
    """(doc_id, text): each text with typed placeholders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = x.text.tolist()
            out: list[str] = []
            for a, b in _in_parts(texts):
                out += [masked(t, f) for t, f in zip(texts[a:b], find(texts[a:b], weights))]
            yield pd.DataFrame({"doc_id": x.doc_id, "text": out})

    empty = docs.where(docs.text.isNull()).select("doc_id", "text")
    return _spread(docs).mapInPandas(run, "doc_id long, text string").unionByName(empty)


def _spread(docs: DataFrame) -> DataFrame:
    """Evenly over all tasks: reading is far dearer than moving the texts."""
    docs = docs.where(docs.text.isNotNull()).select("doc_id", "text")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(cores * 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
