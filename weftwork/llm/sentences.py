"""Problem 4: sentences of documents in ten languages and several scripts.

Method as named: document-centred disambiguation. Whether a full stop ends a sentence is decided by what the same document
shows elsewhere: a word that it also writes with a full stop before a small letter is an abbreviation, one that it writes
without a full stop or at the end of a paragraph is none, a capitalised word that it also writes small is no proper name. Where
the document is silent the corpus answers, by counts over all documents; where that is silent as well, a short list of the
text's language does. Script-specific rules say which marks end sentences at all.

Words of any length may be abbreviations, but the longer the word the more the corpus must show. Stops in quotation marks are
never ends and do not count as evidence.

The corpus answers for every word, with all its counts. Words whose share of all stops or of all small-letter words is
``SHARE`` or more are ``2 / SHARE`` at most by definition, whatever the corpus' size, and are sent to every task. Documents
that ask for rarer words get their counts by a join.

Cases: a null or blank text has no sentences; positions count code points; repeated rows give repeated sentences; an empty
table gives no rows; only named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import cut, salted_join

#: Words of at least this share of the corpus are sent to every task: 100,000 at most by their stops, and as many by small letters.
SHARE = 1e-5

#: Columns of a word's counts: how it goes on after a full stop, in how many documents a capital follows, how often it is written
#: small, and how often without a full stop.
COUNTS = ("l", "d", "e", "u", "c", "docs", "small", "bare")

#: The corpus is silent about words with fewer stops.
FEW = 3

# Abbreviations before names and before numbers, by language, for words of which neither document nor corpus tells.
BEFORE_NAMES = {
    "en": "mr mrs ms dr prof st vs",
    "nl": "dhr mevr mw drs ir dr prof",
    "ru": "проф акад им ул гр",
    "de": "hr fr dr prof bzw resp",
    "fr": "m mm mme mlle dr",
}
BEFORE_NUMBERS = {
    "en": "no nos fig figs p pp vol approx ca cf",
    "nl": "nr blz afb ca art",
    "ru": "рис стр см ок гл д кв",
    "de": "nr abb s bd ca kap",
    "fr": "no fig p art env chap",
}
#: Frequent words that tell the language of a text.
FREQUENT = {
    "en": "the of and to is it that for with was this on",
    "nl": "de het een van en is dat niet met zijn op voor",
    "de": "der die das und ist nicht ein mit den auf für im",
    "fr": "le la les des et est une dans pour que sur il",
}

_BLANK = re.compile(r"\r\n[^\S\n]*(?:\r?\n\s*)|\n[^\S\n]*\n\s*|\r[^\S\r\n]*\r\s*|[ \f]\s*")
_TAG = re.compile(r"<[^<>]+>")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "‘": "’", "{": "}"}
_QUOTES = re.compile(r'[“”«»()\[\]（）「」『』【】《》‘„‚"{}<]')
#: Marks that may end a sentence, with what closes it.
_END = re.compile(r"(?:[.!?…؟۔]|[。！？｡।॥]|\.{2,})(?:[.!?…؟。！？।॥])*")
_CLOSE = re.compile(r"(?:[\"”“»)\]）」』】》’'}]|</[^<>]+>)*")
_CLOSE_SPACED = re.compile(r"[   ]»")
_TOKEN = re.compile(r"[^\s.,;:!?…()\[\]“”„«»\"<>]+(?:\.(?:-?[^\W\d_])+)*$")
_NEXT = re.compile(r"(?:<[^<>]+>)*")
_THAI_GAP = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")
_MONTHS = re.compile(r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
_PARTICLES = frozenset("とのはがをにもでやへ")
_STOP = re.compile(r"\.(?![.\w])(?=(,|;|:|\)|[^\S\n]*(?:\r?\n)?[^\S\n]*(?:<[^<>]+>)?(\w{0,2})))")
#: A word, with the full stop after it.
_WRITTEN = re.compile(r"(?<![\w-])[^\W\d_]+(?![\w-])\.?")
_SMALL_FIRST = re.compile(r"[a-zß-öø-ÿа-яё]")
_QUOTED = frozenset("\"“”„«‚‘「『")


def _wide(c: str) -> bool:
    return "぀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "。！？｡……"


def _starts_small(text: str, at: int) -> bool:
    """A small letter, but for names such as eNova."""
    return text[at].islower() and not (at + 1 < len(text) and text[at + 1].isupper())


def _kind(m: re.Match) -> str:
    """How a word with a full stop goes on: l small letter or mark, d digit, e end of its paragraph, u capital, c other."""
    mark, after = m[1], m[2]
    if mark and mark[0] in ",;:":
        return "l"
    if mark and mark[0] == ")":
        return "c"
    if not after:
        return "e" if not m.string[m.end() :].strip(" \t") or "\n" in m.string[m.end() : m.end() + 4] else "c"
    if after[0].isdigit():
        return "d"
    if after[0].islower():
        return "u" if len(after) > 1 and after[1].isupper() else "l"
    return "u" if after[0].isupper() else "c"


def _stops_in(text: str) -> list[tuple[str, str]]:
    """(word, how it goes on) of words with a full stop, but for those in quotation marks."""
    out = []
    quoted: list[tuple[int, int]] | None = None
    q = 0
    for m in _STOP.finditer(text):
        at = m.start()
        t = _TOKEN.search(text, max(0, at - 40), at)
        if not t or t[0].isdigit():
            continue
        if quoted is None:
            quoted = [(b + x, b + y) for b, e in _spans(text) for x, y in _inside(text[b:e]) if text[b + x] in _QUOTED] if _QUOTES.search(text) else []
        while q < len(quoted) and quoted[q][1] <= at:
            q += 1
        if q == len(quoted) or at < quoted[q][0]:
            out.append((t[0].lower(), _kind(m)))
    return out


def _written(found: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(word in small letters, times written small, times without a full stop) of counts of _WRITTEN."""
    for token, n in found.items():
        w = token.rstrip(".")
        yield w.lower(), n if _SMALL_FIRST.match(w) else 0, n if w == token else 0


class Document:
    """What one document shows of its words, read when it is first asked."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def stops(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for w, k in _stops_in(self.text):
            out.setdefault(w, set()).add(k)
        return out

    @cached_property
    def _words(self) -> set[str]:
        return set(_WRITTEN.findall(self.text))

    def writes_small(self, w: str) -> bool:
        return w in self._words or f"{w}." in self._words

    def writes_bare(self, w: str) -> bool:
        """Written small and without a full stop."""
        return w in self._words

    @cached_property
    def languages(self) -> list[str]:
        """The language with most frequent words; all of the script if none has any."""
        if any("а" <= c <= "я" for c in self.text.lower()):
            return ["ru"]
        own = set(map(str.lower, self._words))
        votes = {k: len(own & set(ws.split())) for k, ws in FREQUENT.items()}
        most = max(votes.values())
        return [k for k, n in votes.items() if n == most]

    def listed(self, w: str, lists: dict[str, str]) -> bool:
        return any(w in lists[k].split() for k in self.languages)


class Answers:
    """What the corpus says: counts of words with a full stop and without one, and the words written small.

    ``ended``: of the stops before a capital or at a paragraph's end, the share of the latter.
    """

    def __init__(self, stops: dict[tuple[str, str], int], small: set[str], bare: dict[str, int] | None = None, docs: dict[str, int] | None = None, ended: float = 0.5):
        self.small, self.bare, self.docs = dict.fromkeys(small), bare or {}, docs or {}
        self.against = -math.log(1 - min(max(ended, 0.05), 0.95))
        self.stops: dict[str, dict[str, int]] = {}
        for (w, k), n in stops.items():
            self.stops.setdefault(w, {})[k] = n

    @classmethod
    def of(cls, rows: list, ended: float = 0.5) -> Answers:
        """From rows of a word and its counts."""
        more = [{r["word"]: r[k] for r in rows if r[k]} for k in ("bare", "docs")]
        return cls({(r["word"], k): r[k] for r in rows for k in "ldeuc" if r[k]}, {r["word"] for r in rows if r["small"] >= 2}, *more, ended)

    def with_rows(self, rows: list) -> Answers:
        """These answers and those of more words."""
        more = Answers.of(rows)
        for k in ("stops", "small", "bare", "docs"):
            setattr(more, k, ChainMap(getattr(more, k), getattr(self, k)))
        more.against = self.against
        return more

    def writes_small(self, w: str) -> bool:
        return w in self.small

    def silent(self, w: str) -> bool:
        return sum(self.stops.get(w, {}).values()) < FEW

    def leads(self, w: str) -> bool:
        """Stands before capitals in many documents and, against what chance would have it, never at the end of a paragraph.

        An ordinary word stands there in a share of ``ended``; the longer the word, the less likely must chance be.
        """
        e, u = self.stops.get(w, {}).get("e", 0), self.docs.get(w, 0)
        return u * self.against >= 4 + 0.6 * len(w) and e * 50 <= u and self.bare.get(w, 0) * 4 <= u

    def abbreviation(self, w: str) -> bool:
        s = self.stops.get(w)
        if not s:
            return False
        l, d, e, u = (s.get(k, 0) for k in "ldeu")
        # a word of more letters must be seen more often, and more often than without a full stop
        longer = max(0, len(w) - 5)
        if l + d >= 2 + longer and l + d > 2 * (e + u) and (not longer or l + d > self.bare.get(w, 0)):
            return True
        return self.leads(w)

    def ends(self, w: str) -> bool:
        """Seen at ends of paragraphs as well."""
        s = self.stops.get(w, {})
        return s.get("e", 0) * 20 > sum(s.values())


class Asking(Answers):
    """Answers for the words that are known; the others that a verdict may need are noted in ``asked``."""

    def __init__(self, known: Answers, words: set[str]):
        self.small, self.stops, self.bare, self.docs, self.against, self.words = known.small, known.stops, known.bare, known.docs, known.against, words
        self.asked: set[str] = set()

    def _known(self, w: str) -> bool:
        if w not in self.words:
            self.asked.add(w)
        return w in self.words

    def silent(self, w: str) -> bool:
        return self._known(w) and super().silent(w)

    def abbreviation(self, w: str) -> bool:
        return not self._known(w) or super().abbreviation(w)

    def leads(self, w: str) -> bool:
        return self._known(w) and super().leads(w)

    def ends(self, w: str) -> bool:
        return self._known(w) and super().ends(w)

    def writes_small(self, w: str) -> bool:
        return self._known(w) and super().writes_small(w)


def _spans(text: str) -> list[tuple[int, int]]:
    """Paragraphs: what blank lines keep apart."""
    out, at = [], 0
    for m in _BLANK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def _inside(par: str) -> list[tuple[int, int]]:
    """Spans of what stands in quotation marks or brackets, outermost, and of tags. An opening mark without its other is no mark."""
    marks = []
    i = 0
    while m := _QUOTES.search(par, i):
        c, i = m[0], m.end()
        if c == "<":
            t = _TAG.match(par, m.start())
            if t:
                marks.append((m.start(), "t", t.end()))
                i = t.end()
            continue
        marks.append((m.start(), c, m.end()))
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(marks):
        at, c, end = marks[k]
        if c == "t":
            out.append((at, end))
            k += 1
            continue
        closers = {"„": "“”", "‚": "‘’", '"': '"', "“": "”"}.get(c) or _PAIRS.get(c, "")
        close, depth = None, 0
        for j in range(k + 1, len(marks)):
            x = marks[j][1]
            if x in closers:
                if not depth:
                    close = j
                    break
                depth -= 1
            elif x == c:
                depth += 1
        if closers and close is not None:
            out.append((at, marks[close][2]))
            k = close + 1
        else:
            k += 1
    return out


def sentences(text: str | None, corpus: Answers) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points."""
    if not text:
        return []
    doc = Document(text)
    out: list[tuple[int, int]] = []
    for begin, end in _spans(text):
        par = text[begin:end]
        cuts: list[int] = []
        inside = _inside(par)
        g = 0
        for m in _END.finditer(par):
            s, e = m.span()
            while g < len(inside) and inside[g][1] <= s:
                g += 1
            quoted = g < len(inside) and inside[g][0] <= s < inside[g][1]
            if quoted:
                # only a mark just before the close can end the sentence around it
                close = _CLOSE.match(par, e).end()
                if close == e and (z := _CLOSE_SPACED.match(par, e)):
                    close = z.end()
                if close < inside[g][1] or par[inside[g][0]] in "([（【{<":
                    continue
                e, last = close, par[close - 1]
                nxt = _NEXT.match(par, e).end()
                rest = par[nxt:].lstrip()
                if not rest:
                    continue
                gap = nxt < len(par) and par[nxt].isspace()
                c = rest[0]
                if c in ",;:，、؛،-–—.!?。！？…" or _starts_small(rest, 0) or c in _PARTICLES:
                    continue
                if not gap and not _wide(last) and not _wide(c) and not c.isalpha():
                    continue
                if not gap and last in "\"”“»" and c.isascii() and not _wide(par[s]):
                    continue
                cuts.append(e)
                continue
            e = _CLOSE.match(par, e).end()
            nxt = _NEXT.match(par, e).end()
            if nxt >= len(par):
                continue
            wide = m[0][0] in "。！？｡" or (m[0][0] == "…" and s > 0 and _wide(par[s - 1]))
            if wide:
                if par[nxt] in "，、；：,;:" or par[nxt] in _PARTICLES and m[0][0] == "…":
                    continue
                cuts.append(e)
                continue
            if not par[nxt].isspace():
                continue
            at = nxt
            while at < len(par) and par[at].isspace():
                at += 1
            at = _NEXT.match(par, at).end()
            if at >= len(par):
                continue
            c = par[at]
            if m[0][0] in "।॥؟۔":
                if c not in ",;:،؛—–-":
                    cuts.append(e)
                continue
            if c in ",;:،؛)—–-" or _starts_small(par, at):
                continue
            if m[0] == ".":
                t = _TOKEN.search(par, max(0, s - 40), s)
                word = t[0] if t else ""
                if word and not _ends(word, par, s, at, corpus, doc):
                    continue
            cuts.append(e)
        if "฀" <= max(par, default="") and re.search("[ก-๛]", par):
            cuts += [m.start() for m in _THAI_GAP.finditer(par) if not any(a < m.start() < b for a, b in inside)]
            cuts.sort()
        at = 0
        for cut in [*cuts, len(par)]:
            piece = par[at:cut]
            stripped = piece.strip()
            if stripped:
                left = at + len(piece) - len(piece.lstrip())
                out.append((begin + left, begin + left + len(stripped)))
            at = cut
    return out


def _ends(word: str, par: str, s: int, at: int, corpus: Answers, doc: Document) -> bool:
    """Whether the full stop at ``s`` after ``word`` ends its sentence; the next one would start at ``at``, not in a small letter."""
    c = word[-1]
    if word.isdigit():
        return not (len(word) <= 2 and _MONTHS.match(par, s + 1))
    if "ऀ" <= c <= "෿" or "฀" <= c <= "๿":
        return False
    low = word.lower().lstrip("(’'‘-")
    if "." not in low and any(x.isdigit() for x in low):
        return True
    if len(low) == 1 and par[at] not in "“«„\"‘" and (word.isupper() or not ("a" <= low <= "z" or "а" <= low <= "я")):
        return False
    number = par[at].isdigit()
    kinds = doc.stops.get(low, ())
    if "l" not in kinds and "." not in low:
        # the document itself: an ordinary word, unless a number follows that the word may announce
        if not number and (doc.writes_bare(low) or "e" in kinds and len(low) > 1):
            return True
        if corpus.silent(low):
            if doc.listed(low, BEFORE_NUMBERS if number else BEFORE_NAMES):
                return False
            if len(low) > 1 or doc.writes_bare(low):
                return True
        elif not corpus.abbreviation(low) and len(low) > 1:
            return True
    if number:
        return False
    if corpus.leads(low):
        return False
    m = _WORDS.match(par, at)
    follow = m[0].lower() if m and not (len(m[0]) > 1 and m[0].isupper()) else ""
    common = bool(follow) and (doc.writes_small(follow) or corpus.writes_small(follow))
    return common or corpus.ends(low) or not m and par[at] in "“«„\""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stops: Counter = Counter()
    words: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows: dict[str, Counter] = defaultdict(Counter)
        for w, small, bare in _written(words):
            rows[w].update(small=small, bare=bare)
        for (w, k), n in stops.items():
            rows[w][k] += n
        counts = [pa.array([r[k] for r in rows.values()], pa.int64()) for k in COUNTS]
        stops.clear()
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), *counts], names=["word", *COUNTS])

    for x in batches:
        for text in x["text"].to_pylist():
            found = _stops_in(text)
            stops.update(found)
            stops.update({(w, "docs") for w, k in found if k == "u"})
            words.update(_WRITTEN.findall(text))
        if len(stops) + len(words) > 200_000:
            yield out()
    yield out()


def corpus_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Counts over all documents, a row for each word: those of SHARE or more by stops or small letters, and the others that say anything.

    Also the share of stops at a paragraph's end among those and the stops before a capital.
    """
    counts = docs.select("text").mapInArrow(_count, "word string, " + ", ".join(f"{k} long" for k in COUNTS)).groupBy("word").agg(*[F.sum(k).alias(k) for k in COUNTS])
    counts = cut(counts.withColumn("stops", sum((F.col(k) for k in "deuc"), F.col("l"))))
    totals = counts.agg(F.sum("stops").alias("stops"), F.sum("small").alias("small"), F.sum("e").alias("e"), F.sum("u").alias("u")).first()
    common = F.lit(False)
    for c in ("stops", "small"):
        common |= (F.col(c) > 0) & (F.col(c) >= F.lit((totals[c] or 0) * SHARE))
    ended = (totals["e"] or 0) / max(1, (totals["e"] or 0) + (totals["u"] or 0))
    return counts.where(common), counts.where(~common & ((F.col("stops") > 0) | (F.col("small") >= 2))), ended


def _lists(spans: list[list[int]]) -> pa.Array:
    return pa.array(spans, pa.list_(pa.int32()))


def split_sentences(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(rec_table, rec_id, start_pos, end_pos) of each sentence of (rec_table, rec_id, text); ``corpus``: texts that are counted, if others."""
    docs = docs.where("text is not null").select("rec_table", "rec_id", "text")
    common, rare, ended = corpus_counts(docs if corpus is None else corpus.where("text is not null"))
    # at most 2 / SHARE rows
    rows = common.collect()
    shared = docs.sparkSession.sparkContext.broadcast((Answers.of(rows, ended), {r["word"] for r in rows}))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sentences; or the text and the words whose counts are wanted, where the common words do not decide."""
        corpus = Asking(*shared.value)
        for x in batches:
            starts, ends, texts, asked = [], [], [], []
            for text in x["text"].to_pylist():
                corpus.asked.clear()
                found = sentences(text, corpus)
                wanted = sorted(corpus.asked)
                found = [] if wanted else found
                starts.append([a for a, _ in found])
                ends.append([b for _, b in found])
                texts.append(text if wanted else None)
                asked.append(wanted)
            columns = [x["rec_table"], x["rec_id"], _lists(starts), _lists(ends), pa.array(texts, pa.string()), pa.array(asked, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rec_table", "rec_id", "starts", "ends", "text", "asked"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = shared.value
        for x in batches:
            found = [sentences(text, known.with_rows(told or [])) for text, told in zip(x["text"].to_pylist(), x["told"].to_pylist())]
            columns = [x["rec_table"], x["rec_id"], _lists([[a for a, _ in f] for f in found]), _lists([[b for _, b in f] for f in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["rec_table", "rec_id", "starts", "ends"])

    kept = "rec_table string, rec_id long, starts array<int>, ends array<int>"
    read = cut(docs.mapInArrow(first, f"{kept}, text string, asked array<string>")).withColumn("row", F.monotonically_increasing_id())
    asked = read.select("row", F.explode("asked").alias("word"))
    known = asked.select("word").distinct().join(rare, "word")
    told = salted_join(asked, known, ["word"], ["row"]).groupBy("row").agg(F.collect_list(F.struct("word", *COUNTS)).alias("told"))
    opened = read.where("text is not null").join(told, "row", "left").select("rec_table", "rec_id", "text", "told").mapInArrow(again, kept)
    spans = read.where("text is null").select("rec_table", "rec_id", "starts", "ends").unionByName(opened)
    spans = spans.select("rec_table", "rec_id", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return spans.select("rec_table", "rec_id", F.col("s.starts").alias("start_pos"), F.col("s.ends").alias("end_pos"))


def documents_of(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(rec_table, rec_id, text) of plain-text files and of segments' sources."""
    a = files.where("kind in ('txt', 'pdf')").select(F.lit("files").alias("rec_table"), F.col("id").alias("rec_id"), F.col("original").alias("text"))
    b = segments.select(F.lit("segments").alias("rec_table"), F.col("id").alias("rec_id"), F.col("source").alias("text"))
    return a.unionByName(b).where("text is not null")


def clean_sentences(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Sentences of the records that are not garbled."""
    from weftwork.llm.garbled import find_garbled, records_of

    docs = documents_of(files, segments)
    bad = cut(find_garbled(records_of(files, segments)))
    return split_sentences(docs.join(bad, ["rec_table", "rec_id"], "left_anti"), docs)
