"""Problem 5: text that was read in a wrong encoding, and the text it was.

Method as named. The distinct words of the corpus that look clean are put through every encoding chain; what comes out is a
table from garbled form to original. The distinct words of the records meet this table in a hash join; what has an entry is
garbled, if its original looks better or is far more frequent. Records are found by their garbled words and get the
originals back; a record's other runs are decoded by the chain that its words named, if that succeeds in full.

A word is a run of letters of which some are not ASCII, or a run of other characters than ASCII: those pass through nearly
every chain one for one. Chains that lose text leave question marks or U+FFFD: these are matched the same way.

Cases: a null or empty text is never garbled; null ids are kept as they come; repeated rows give repeated verdicts, found
rows are distinct; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import cut, salted_join

# Encodings in which texts are stored, and in which they are wrongly read.
SINGLE = ["cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-5", "mac_cyrillic", "cp1256", "cp874", "iso8859-15"]
MULTI = ["shift_jis", "euc_jp", "gbk", "big5"]
_WIDE = frozenset([*MULTI, "utf-8"])
#: Marks that clean text holds as well.
COMMON_MARKS = "“”‘’«»„‚‹›–—…·¿¡、。！？（）「」『』：；，।॥؟،؛°№€"

#: Words with letters other than ASCII; runs without ASCII; question marks where letters would stand.
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_MARKS = re.compile(r"""(?<![“«„"'?A-Za-z])\?{2,}(?![”»“"'?!A-Za-z])|(?<![A-Za-z?])(?:[A-Za-z]+\?[A-Za-z?]*[A-Za-z?]|\?+[A-Za-z][A-Za-z?]*)""")
#: Bits of the filter over all words of the corpus for each of them, and at least and at most: 32 MiB go to every task whatever
#: the corpus. Up to 16 million words it lets one foreign form in 16 pass, up to 134 million two in five.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


@lru_cache(None)
def _reading(encoding: str) -> str:
    """What each byte is read as; bytes the encoding leaves open are read as C1 controls."""
    return "".join(bytes([b]).decode(encoding, "replace").replace("\ufffd", chr(b)) for b in range(256))


def read_as(raw: bytes, encoding: str) -> str:
    if encoding in _WIDE:
        return raw.decode(encoding, "replace")
    return codecs.charmap_decode(raw, "strict", _reading(encoding))[0]


@lru_cache(None)
def _writing(encoding: str):
    return codecs.charmap_build(_reading(encoding))


def written(text: str, encoding: str) -> bytes | None:
    """The bytes that are read as ``text``, or None."""
    try:
        return text.encode(encoding) if encoding in _WIDE else codecs.charmap_encode(text, "strict", _writing(encoding))[0]
    except UnicodeEncodeError:
        return None


def chains() -> list[tuple[str, ...]]:
    """(stored, read[, stored, read]): every way of garbling that keeps the text."""
    once = [("utf-8", r) for r in [*SINGLE, "gbk", "shift_jis", "big5"]]
    once += [(w, r) for w in [*SINGLE, *MULTI] for r in SINGLE if w != r]
    once += [(w, "utf-8") for w in SINGLE]
    twice = [("utf-8", a, "utf-8", b) for a in SINGLE for b in SINGLE]
    return list(dict.fromkeys(once + twice))


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    for stored, read in zip(chain[::2], chain[1::2]):
        raw = written(text, stored)
        if raw is None:
            return None
        text = read_as(raw, read)
    return text


def restore(text: str, chain: tuple[str, ...]) -> str | None:
    """The inverse of ``garble``, None where it fails."""
    for stored, read in reversed(list(zip(chain[::2], chain[1::2]))):
        raw = written(text, read)
        if raw is None:
            return None
        try:
            text = raw.decode(stored) if stored in _WIDE else read_as(raw, stored)
        except UnicodeDecodeError:
            return None
    return text


@lru_cache(65536)
def _char(c: str) -> tuple[int, str, bool, bool, bool]:
    """Cost, script, upper, lower, accented."""
    o, cat = ord(c), unicodedata.category(c)
    if c == "�" or cat in ("Cc", "Cn", "Co", "Cs"):
        return 3, "", False, False, False
    if cat[0] == "L":
        name = unicodedata.name(c, "").split(" ")[0]
        name = "J" if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC")) else name
        plain = cat in ("Lu", "Ll") or o > 0x600 and o != 0xFB02 and not 0xFB00 <= o <= 0xFB06
        return int(not plain or 0xFB00 <= o <= 0xFB06), name, c.isupper(), c.islower(), 0xC0 <= o < 0x250
    if cat[0] == "M" or o < 128 or c in COMMON_MARKS or c == "\xa0":
        return 0, "", False, False, False
    return 1, "", False, False, False


def oddness(token: str) -> int:
    """How unlike a word a token looks: 0 for clean words."""
    cost, lower, accent, scripts = 0, False, False, set()
    for c in token:
        k, script, up, low, acc = _char(c)
        cost += k + (lower and up) + (accent and acc)
        lower, accent = low, acc
        if script:
            scripts.add(script)
    return cost + 2 * (len(scripts) > 1) + 2 * ("?" in token)


def _by_start() -> list[tuple[str, list[tuple[str, ...]]]]:
    out: dict[str, list[tuple[str, ...]]] = {}
    for c in chains():
        out.setdefault(c[0], []).append(c)
    return list(out.items())


_CHAINS = _by_start()


def forms(word: str) -> dict[str, tuple[str, ...] | None]:
    """Garbled forms of a word with the first chain that gives each; None for chains that lose text."""
    out: dict[str, tuple[str, ...] | None] = {}
    for stored, group in _CHAINS:
        raw = written(word, stored)
        if raw is None:
            continue
        once: dict[str, str] = {}
        for chain in group:
            if chain[1] not in once:
                once[chain[1]] = read_as(raw, chain[1])
            form = once[chain[1]]
            if len(chain) > 2:
                form = read_as(form.encode("utf-8"), chain[3])
            if form == word or form.isascii():
                continue
            if form not in out and _WORD.fullmatch(form):
                out[form] = chain if "\ufffd" not in form else None
            if chain[0] in MULTI or chain[-1] in MULTI:
                for run in _RUN.findall(form):
                    if len(run) > 2:
                        out.setdefault(run, None)
    raw = word.encode("utf-8")
    for lost in (raw.decode("ascii", "replace"), _HIGH.sub("\ufffd", word), _HIGH.sub("?", word), written_with_marks(word), raw.decode("cp1252", "ignore")):
        if lost and lost != word:
            out.setdefault(lost, None)
    return out


_HIGH = re.compile(r"[^\x00-\x7f]")


def written_with_marks(word: str) -> str:
    """As stored in latin-1 with question marks for what it lacks."""
    return word.encode("latin-1", "replace").decode("latin-1")


def is_source(word: str) -> bool:
    """Words that go through the chains: clean ones, and next to ASCII letters only Latin ones."""
    if "?" in word or oddness(word) > 1:
        return False
    return not re.search("[A-Za-z]", word) or all(_char(c)[1] in ("", "LATIN") for c in word)


BLOCK = 1 << 16


def filter_of(words: DataFrame, n: int) -> bytes:
    """Bits that are set at the hashes of ``n`` words: made by blocks of BLOCK bits, of which each is a row of 8 KiB for the driver."""
    size = LEAST_BITS
    while size < min(n * BITS_A_WORD, MOST_BITS):
        size *= 2

    def block(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, np.uint8)
        bits[x.bit.to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slot = F.pmod(F.xxhash64("token"), F.lit(size))
    places = words.select(F.floor(slot / BLOCK).cast("int").alias("block"), (slot % BLOCK).cast("int").alias("bit"))
    out = bytearray(size // 8)
    for r in places.groupBy("block").applyInPandas(block, "block int, bits binary").collect():
        out[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = r.bits
    return bytes(out)


def table_of(words: DataFrame) -> DataFrame:
    """(token, word, own, word_n, chain, letters): garbled forms of the clean words that may occur among all words.

    A filter of bounded size drops most forms that no word of the corpus has, before they are shuffled.
    """
    n = words.count()
    shared = words.sparkSession.sparkContext.broadcast(filter_of(words, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = shared.value
        mask = len(taken) * 8 - 1
        for x in batches:
            rows: dict[tuple[str, bool], tuple] = {}  # the cleanest original of each form, and the most frequent
            for word, n in zip(x.token, x.n):
                if not is_source(word):
                    continue
                own, letters = oddness(word), any(c.isalpha() for c in word)
                for form, chain in forms(word).items():
                    at = xxhash.xxh64_intdigest(form, seed=42) & mask  # as pmod(xxhash64(form), size) in Spark
                    if taken[at >> 3] >> (at & 7) & 1:
                        for key, rank in (((form, True), (own, -n, word)), ((form, False), (-n, own, word))):
                            best = rows.get(key)
                            if best is None or rank < best[0]:
                                rows[key] = (rank, (word, own, n, "/".join(chain or ()), letters))
            yield pd.DataFrame(list({(f, *row) for (f, _), (_, row) in rows.items()}), columns=["token", "word", "own", "word_n", "chain", "letters"])

    tasks = min(100_000, max(words.sparkSession.sparkContext.defaultParallelism * 2, n // 20_000))
    return words.where(F.octet_length("token") > F.char_length("token")).repartition(tasks, "token").mapInPandas(run, "token string, word string, own int, word_n long, chain string, letters boolean")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows, tokens = [], []
        for k, text in enumerate(x["text"].to_pylist()):
            found = set()
            if not text.isascii():
                found.update(_WORD.findall(text), _RUN.findall(text))
            if "?" in text:
                found.update(_MARKS.findall(text))
            rows += [k] * len(found)
            tokens += found
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([x["rec_table"].take(at), x["rec_id"].take(at), pa.array(tokens, pa.string())], names=["rec_table", "rec_id", "token"])


def tokens_of(records: DataFrame) -> DataFrame:
    """(rec_table, rec_id, token) of every word that may be garbled, once for each record."""
    return records.where("text is not null").select("rec_table", "rec_id", "text").mapInArrow(_tokens, "rec_table string, rec_id long, token string")


def garbled_words(tokens: DataFrame) -> DataFrame:
    """(token, word, chain, strong) of each distinct word of the records that is a garbled form of another."""
    words = cut(tokens.groupBy("token").agg(F.count("*").alias("n")))
    met = words.join(table_of(words), "token")
    rank = (-F.col("word_n")).alias("rank")
    clean, often = F.min(F.struct("own", rank, "word", "chain", "letters")), F.min(F.struct(rank, "own", "word", "chain", "letters"))
    best = met.groupBy("token").agg(F.max("n").alias("n"), clean.alias("clean"), often.alias("often"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for token, n, *originals in zip(x.token, x.n, x.clean, x.often):
                cost = oddness(token)
                for b in originals:
                    # forms of several bytes of UTF-8 hardly arise otherwise
                    odd, more = cost > b["own"] or len(token) > 1 and b["chain"].startswith("utf-8/"), -b["rank"]
                    if cost < b["own"]:
                        continue
                    if n <= more * 20 if odd and len(token) > 1 else more > n * (3 if b["letters"] else 20):
                        strong = len(token) >= 4 if set(token) == {"?"} else odd or len(token) >= 3 and b["letters"]
                        rows.append((token, b["word"], b["chain"], strong))
                        break
            yield pd.DataFrame(rows, columns=["token", "word", "chain", "strong"])

    return best.mapInPandas(judge, "token string, word string, chain string, strong boolean")


def records_of(files: DataFrame, segments: DataFrame) -> DataFrame:
    a = files.select(F.lit("files").alias("rec_table"), F.col("id").alias("rec_id"), F.col("original").alias("text"))
    b = segments.select(F.lit("segments").alias("rec_table"), F.col("id").alias("rec_id"), F.col("source").alias("text"))
    return a.unionByName(b).where("text is not null")


def garbled_tokens(records: DataFrame) -> DataFrame:
    """(rec_table, rec_id, subs): garbled records with their words' originals."""
    tokens = cut(tokens_of(records))
    bad = cut(garbled_words(tokens))
    found = _verdicts(tokens, bad)
    subs = salted_join(tokens, bad, ["token"], ["rec_id"]).groupBy("rec_table", "rec_id").agg(F.collect_set(F.struct("token", "word", "chain")).alias("subs"))
    return subs.join(found, ["rec_table", "rec_id"], "left_semi")


def _verdicts(tokens: DataFrame, bad: DataFrame) -> DataFrame:
    """Records with one sure garbled word, or with two that are short and make half of its words."""
    hit = salted_join(tokens, bad.select("token", "strong"), ["token"], ["rec_id"])
    sure = hit.where("strong").select("rec_table", "rec_id").distinct()
    weak = hit.where("not strong").groupBy("rec_table", "rec_id").agg(F.count("*").alias("hits")).where("hits >= 2")
    shares = tokens.join(weak, ["rec_table", "rec_id"]).groupBy("rec_table", "rec_id").agg(F.count("*").alias("all"), F.max("hits").alias("hits")).where("hits * 2 >= all")
    return sure.unionByName(shares.select("rec_table", "rec_id")).distinct()


def find_garbled(records: DataFrame) -> DataFrame:
    """(rec_table, rec_id) of the records that are garbled, wholly or in part."""
    tokens = cut(tokens_of(records))
    return _verdicts(tokens, cut(garbled_words(tokens)))


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for text, subs in zip(x.text, x.subs):
            table = {s["token"]: s["word"] for s in subs if s["chain"] or "?" not in s["token"]}
            names = [s["chain"] for s in subs if s["chain"]]
            chain = tuple(max(sorted(set(names)), key=names.count).split("/")) if names else ()

            def back(m: re.Match) -> str:
                if m[0] in table:
                    return table[m[0]]
                plain = restore(m[0], chain) if chain else None
                return plain if plain and oddness(plain) < oddness(m[0]) + (chain[0] == "utf-8") else m[0]

            text = _WORD.sub(lambda m: table[m[0]] if m[0] in table else _RUN.sub(back, m[0]), text)
            lossy = [t for t in table if "?" in t and t in text]
            for t in sorted(lossy, key=len, reverse=True):
                text = text.replace(t, table[t])
            out.append(text)
        x["restored"] = out
        yield x[["rec_table", "rec_id", "text", "restored"]]


def restored(records: DataFrame) -> DataFrame:
    """(rec_table, rec_id, text, restored) of the garbled records; what no original explains stays as it was."""
    return records.join(garbled_tokens(records), ["rec_table", "rec_id"]).mapInPandas(_restore, "rec_table string, rec_id long, text string, restored string")
