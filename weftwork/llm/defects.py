"""Problem 3: pairs whose target is no proper answer to its source, with the defect.

Methods as named, one for each defect, in this order; the first that holds counts.

* empty: no letter or digit once tags are gone.
* refusal: an Aho-Corasick automaton over phrases of declining, in ten languages: a phrase in which the writer declines, with
  one that names the task. If the source declines as well it is a translation.
* copy: a suffix automaton of the source is traversed with the target; the share of the target's words and of the source's
  that longer common runs cover is measured.
* wrong_language: scripts, then votes of the target's words for languages, by how often each occurs in targets of that
  language over the whole corpus; words that the source holds too have no vote. Fixed stop words stand for languages that
  the corpus lacks.
* truncated: delimiter stacks, a last word that is the beginning of a name of the source, names and numbers of the source's
  that are missing, and the length against the language pair's usual ratio.

Corpus tables hold words of a share of at least ``SHARE`` among a language's words: no more than ``1 / SHARE`` rows for each.

Cases: a null target is empty; a null source is ''; a null language is '' and gets no
verdict on language, but may be copied; repeated rows are
judged each; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import norm_lang
from weftwork.llm.consistent import INVISIBLE, OTHER_SPACES, mixed_tokens, plain_form
from weftwork.session import cut, salted_join

SHARE = 1e-4
UNSPACED = frozenset(["zh", "ja", "th"])

# Phrases of declining, and of what is declined, in lower case.
DECLINE = """
i am unable to|i'm unable to|i am not able to|i'm not able to|i cannot|i can't|i can not|i won't|i will not|i must decline|i have to decline|i must refuse
i'm afraid i|i do not feel able|as a translation assistant|as an ai|as a language model|unable to comply
не могу|мне нельзя|вынужден отказаться|вынуждена отказаться|не имею права|я не в состоянии|как помощник переводчика|как языковая модель|я отказываюсь
kan ik geen|kan ik niet|kan ik niets|ik kan geen|ik kan niet|mag ik niet|mag ik geen|ik mag niet|ik mag geen|moet ik afzien|moet ik weigeren|ik moet afzien|als vertaalassistent|als taalmodel|ik ben niet in staat|ben ik niet in staat
ich kann nicht|kann ich nicht|kann ich keine|ich kann keine|ich kann diesen|kann ich diesen|ich kann dies|kann ich dies|ich darf nicht|darf ich nicht|muss ich ablehnen|ich muss ablehnen|als übersetzungsassistent|als sprachmodell|nicht in der lage|kann ich leider|ich kann leider
je ne peux pas|je ne peux|je ne suis pas en mesure|je dois refuser|je dois décliner|en tant qu'assistant|il m'est impossible|je suis dans l'impossibilité|je ne puis
no puedo|lo siento, pero no
我无法|我不能|无法翻译|不能翻译|无法提供|作为翻译助手|翻訳できません|翻訳することはできません|お手伝いできません|応じられません|お答えできません
अनुवाद नहीं कर|मैं नहीं कर|मदद नहीं कर|लا أستطيع|لا يمكنني|لا أستطيع|أعتذر عن|لست قادرا|ไม่สามารถแปล|ไม่สามารถช่วย|ไม่สามารถให้
"""
TASK = """
translat|help with|process this|process that|process the|process your|render this|render that|render the|render your|request|this text|that text|this segment|that segment|this sentence|that sentence|this material|this content|requested content
перев|запрос|текст|фрагмент|предложени|помочь|помощ
vertal|helpen|verzoek|tekst|segment|deze zin|die zin|inhoud
übersetz|helfen|anfrage|diesen text|diesen satz|segment|inhalt
tradui|traduct|aider|demande|ce texte|cette phrase|ce segment|contenu
traduc|ayudar|翻译|请求|文本|内容|帮助|翻訳|依頼|文章|手伝|अनुवाद|अनुरोध|मदद|पाठ|ترجم|طلب|نص|مساعد|แปล|คำขอ|ข้อความ|ช่วย
"""
#: Stop words, for languages of which the corpus holds few targets.
STOPWORDS = {
    "en": "the of and to in is for with on that this are was be as at by an it from or not you if has before after when because unless until your",
    "nl": "de het een van en in is op te voor met zijn niet aan dat die bij als om door naar uit wordt zodra tenzij terwijl omdat voordat nadat uw",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus bei nach wenn sobald während bevor weil sie",
    "fr": "le la les de des du et en un une est que pour dans qui sur au aux avec ne pas par plus ce cette sont si avant après dès car sauf",
    "es": "el la los las de del y en un una es que para por con no se su al como más pero antes después cuando porque si",
    "it": "il lo la gli le di del della e in un una è che per con non si al come più ma prima dopo quando perché se",
    "pt": "o a os as de do da e em um uma é que para por com não se ao como mais mas antes depois quando porque",
    "ru": "и в не на что с по к из за от для как до это его если пока когда так после прежде чем",
    "uk": "і в не на що з по до від для як це його якщо поки коли так після",
}
SCRIPTS = {"ru": "CYR", "uk": "CYR", "zh": "HAN", "ja": "HAN", "hi": "DEV", "ar": "ARA", "th": "THA", **dict.fromkeys(["en", "nl", "de", "fr", "es", "it", "pt"], "LAT")}

#: Titles, after which a name may be replaced.
TITLES = frozenset("dr prof mr mrs ms mevr mevrouw dhr drs frau herr mme".split())

_TAG = re.compile(r"<[^<>]+>")
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[A-Za-zÀ-ɏА-яЁё0-9]+|[^\W_]")
_SCRIPT = re.compile(r"([A-Za-zÀ-ɏ])|([Ѐ-ӿ])|([぀-ヿ一-鿿])|([ऀ-ॿ])|([؀-ۿ])|([฀-๿])")
_SCRIPT_NAMES = ("LAT", "CYR", "HAN", "DEV", "ARA", "THA")
_ODD = re.compile("[" + re.escape(INVISIBLE + OTHER_SPACES) + "̀-ͯ０-９Ａ-Ｚａ-ｚ]|[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z]")
_NAME = re.compile(r"[A-Za-z0-9]+")  # of a target, in whose words other scripts may stand next to a name
_FINAL = re.compile(r"[.!?…。！？।॥؟;:][\"”“»)\]）」』’' ]*$")
_BROKEN = re.compile(r"(?:[,–—-]|\.{2,}|…)\s*$")
_OPEN = {"“": "”", "„": "“”", "«": "»", "(": ")", "（": "）", "「": "」", "[": "]"}


def _automaton(*texts: str):
    a = ahocorasick.Automaton()
    for kind, text in enumerate(texts):
        for phrase in re.split(r"[|\n]", text.strip()):
            a.add_word(phrase, (kind, phrase))
    a.make_automaton()
    return a


class _Lazy:
    """The automaton is built once in each worker."""

    made = None

    def __call__(self):
        if self.made is None:
            self.made = _automaton(DECLINE, TASK)
        return self.made


_refusals = _Lazy()


#: Scripts that are written without spaces, in whose phrases no word has to begin.
_RUNNING = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")


def declines(text: str) -> bool:
    """Whether the writer declines a task of translation: a phrase of declining and one that names the task.

    Phrases begin where a word does, and phrases of declining end where one does; but for scripts without spaces.
    """
    text = " ".join(text.lower().replace("’", "'").split())
    seen = set()
    for last, (kind, phrase) in _refusals().iter(text):
        if not _RUNNING.match(phrase):
            before, after = text[last - len(phrase) : last - len(phrase) + 1] if last >= len(phrase) else "", text[last + 1 : last + 2]
            if before.isalnum() or before == "'" or kind == 0 and after.isalnum() and phrase[-1].isalnum():
                continue
        seen.add(kind)
    return seen >= {0, 1}


def tidy(text: str) -> str:
    """Without tags; odd characters as in problem 6, look-alikes by the token's dominant script."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii() and _ODD.search(text):
        text, _ = plain_form(text)
        for token, words in mixed_tokens(text):
            if words:
                text = text.replace(token, words[0])
    return text


class SuffixAutomaton:
    """Of a sequence of words."""

    __slots__ = ("next", "link", "length")

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.length)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.length)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], least: int) -> int:
        """How many of ``words`` lie in runs of at least ``least`` words that occur in the sequence."""
        state = run = 0
        total, reach = 0, -1
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            if run >= least:
                total += i - max(reach, i - run)
                reach = i
        return total


def copied_share(source: list[str], target: list[str], least: int = 2) -> float:
    """The smaller of the shares of target and source that common runs cover."""
    if not source or not target:
        return 0.0
    known = set(source)
    shared = sum(w in known for w in target)
    if shared * 10 < 8 * len(target) and shared < 0.8 * len(source):
        return 0.0  # the coverage can't be more
    least = min(least, len(source), len(target))
    n = SuffixAutomaton(source).covered(target, least)
    return min(1.0, n / len(source)) if n >= 0.6 * len(target) else min(n / len(target), n / len(source))


def script_counts(text: str) -> Counter:
    return Counter(_SCRIPT_NAMES[m.lastindex - 1] for m in _SCRIPT.finditer(text))


def _unclosed(text: str) -> int:
    """How many opening delimiters are left on the stack."""
    stack: list[str] = []
    for c in text:
        if stack and c in stack[-1]:
            stack.pop()
        elif c in _OPEN:
            stack.append(_OPEN[c])
    return len(stack)


class Corpus:
    """What all pairs say: word shares of each target language, how often a source word is copied, usual lengths."""

    def __init__(self, words: dict[str, dict[str, float]], copied: dict[str, float], ratio: dict[str, float]):
        self.copied, self.ratio = copied, ratio
        for lang, ws in STOPWORDS.items():
            own = words.setdefault(lang, {})
            for w in ws.split():
                own.setdefault(w, 0.002)
        self.logs: dict[str, dict[str, float]] = defaultdict(dict)
        for lang, own in words.items():
            for w, share in own.items():
                self.logs[w][lang] = math.log(share / (SHARE / 2))


def other_language(target: str, words: list[str], own: set[str], lang: str, corpus: Corpus) -> bool:
    want = SCRIPTS.get(lang)
    if lang in UNSPACED:
        words = _PIECE.findall(target.lower())
    new = [w for w in words if w not in own and not w.isdigit()]
    if want:
        counts = script_counts(" ".join(new))
        total = sum(counts.values())
        kana = any("぀" <= c <= "ヿ" for c in target)
        if want != "LAT":
            if total >= 6 and counts[want] * 4 < total:
                return True
            if lang == "zh" and kana and counts["HAN"] >= 4:
                return True
            if lang == "ja" and not kana and counts["HAN"] >= 6:
                return True
            if want != "CYR":
                return False
        elif total >= 4 and counts["LAT"] * 2 < total:
            return True
    votes: Counter = Counter()
    voters: Counter = Counter()
    for w in new:
        for language, weight in corpus.logs.get(w, {}).items():
            votes[language] += weight
            voters[language] += 1
    if not votes or not lang:
        return False
    best = max(sorted(votes), key=votes.__getitem__)
    return best != lang and voters[best] >= 2 and votes[best] >= 2.0 * votes[lang] + 3.0


def names_of(text: str, corpus: Corpus) -> list[str]:
    """Words of a source that a translation keeps: numbers, codes and names, but for persons' after a title or initial."""
    out, before = [], ""
    for w in _WORD.findall(text):
        low, person = w.lower(), before in TITLES or len(before) == 1 and before.isalpha()
        before = low
        if w.isdigit():
            if len(w) >= 3:
                out.append(low)
        elif len(w) >= 2 and w.isascii() and not person:
            rate = corpus.copied.get(low)
            if rate is None:
                if w[0].isupper() and len(w) >= 4 or any(c.isdigit() for c in w):
                    out.append(low)
            elif rate >= 0.6 and len(w) >= 4:
                out.append(low)
    return out


def _nearly(name: str, words: set[str]) -> bool:
    """Whether a name is there but for a misspelling: one letter, or letters exchanged."""
    own = Counter(name)
    return any(abs(len(w) - len(name)) <= 1 and (own - (c := Counter(w))).total() <= 1 and (c - own).total() <= 1 for w in words)


def breaks_off(source: str, target: str, langs: str, corpus: Corpus) -> bool:
    names = list(dict.fromkeys(names_of(source, corpus)))
    words = {w.lower() for w in _NAME.findall(target)}
    run = "".join(_NAME.findall(target.lower()))
    missing = [n for n in names if n not in words and n not in run]
    if missing and len(missing) <= 2:
        missing = [n for n in missing if len(n) < 5 or n.isdigit() or not _nearly(n, words)]
    source, target = " ".join(source.split()), " ".join(target.split())
    end = target
    usual = corpus.ratio.get(langs, 1.0)
    ratio = len(end) / max(1.0, len(source) * usual)
    closed = bool(_FINAL.search(source))
    cut = bool(_BROKEN.search(end)) and not _BROKEN.search(source)
    open_end = closed and not _FINAL.search(end)
    last = _NAME.findall(end)[-1:] if end and end[-1].isalnum() else []
    if last and last[0].lower() not in names and ratio < 0.97 and (open_end or not closed) and any(n.startswith(last[0].lower()) and len(n) > len(last[0]) for n in missing):
        return True
    if _unclosed(end) > _unclosed(source) and (open_end or cut) and ratio < 0.95:
        return True
    if cut and (missing or ratio < 0.85):
        return True
    if open_end and (ratio < 0.93 and missing or ratio < 0.78):
        return True
    return len(missing) >= 2 and ratio < 0.75 or bool(missing) and ratio < 0.6


def defect_of(source: str, target: str, src: str, tgt: str, corpus: Corpus) -> str | None:
    t = tidy(target)
    words = _WORD.findall(t.lower())
    if not words:
        return "empty"
    s = tidy(source)
    if declines(t) and not declines(s):
        return "refusal"
    own = _WORD.findall(s.lower())
    if src != tgt or not src:
        if src in UNSPACED:
            a, b = _PIECE.findall(s.lower()), _PIECE.findall(t.lower())
            if any(not x.isascii() for x in a) and copied_share(a, b, 3) >= 0.85:
                return "copy"
        elif len(own) >= 4 and copied_share(own, words) >= 0.85:
            return "copy"
    if src != tgt:
        if other_language(t, words, set(own), tgt, corpus):
            return "wrong_language"
    if breaks_off(s, t, f"{src}>{tgt}", corpus):
        return "truncated"
    return None


def pairs_of(units: DataFrame, segments: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """(rec_table, rec_id, src, tgt, source, target) of all units and of finished segments."""
    a = units.select(F.lit("tm_units").alias("rec_table"), F.col("id").alias("rec_id"), norm_lang(F.col("src_lang")).alias("src"), norm_lang(F.col("tgt_lang")).alias("tgt"), "source", "target")
    langs = files.select(F.col("id").alias("file_id"), "project_id").join(projects.select(F.col("id").alias("project_id"), norm_lang(F.col("src_lang")).alias("src"), norm_lang(F.col("tgt_lang")).alias("tgt")), "project_id").drop("project_id")
    done = segments.where("state in ('translated', 'approved')").select("file_id", F.lit("segments").alias("rec_table"), F.col("id").alias("rec_id"), "source", "target")
    b = done.join(langs, "file_id", "left").select("rec_table", "rec_id", F.coalesce("src", F.lit("")).alias("src"), F.coalesce("tgt", F.lit("")).alias("tgt"), "source", "target")
    return a.unionByName(b)


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts: 'w' target words by language, 's' source words, 'c' of them copied, 'r' lengths' ratios by pair, in hundredths."""
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(*k, n) for k, n in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["what", "lang", "word", "n"])

    for x in batches:
        for src, tgt, source, target in zip(x.src, x.tgt, x.source, x.target):
            if not target or not source:
                continue
            a, b = set(_WORD.findall(source.lower())), set(_WORD.findall(target.lower()))
            both = a & b
            counts.update([("w", tgt, w) for w in b - both if not w.isdigit()])
            counts.update([("s", "", w) for w in a if w.isascii()])
            counts.update([("c", "", w) for w in both if w.isascii()])
            counts["r", f"{src}>{tgt}", str(min(400, 100 * len(target.strip()) // max(1, len(source.strip()))))] += 1
        if len(counts) > 200_000:
            yield out()
    yield out()


def corpus_of(pairs: DataFrame) -> Corpus:
    counts = cut(pairs.select("src", "tgt", "source", "target").mapInPandas(_observe, "what string, lang string, word string, n long").groupBy("what", "lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.where("what in ('w', 's')").groupBy("what", "lang").agg(F.sum("n").alias("total"))
    kept = salted_join(counts, totals, ["what", "lang"], ["word"], "left")
    kept = kept.where((F.col("what") == "r") | ((F.col("what") == "w") & (F.col("n") >= F.col("total") * SHARE)) | ((F.col("what") == "s") & (F.col("n") >= F.col("total") * SHARE / 10)))
    rows = kept.collect()
    sources = {r.word: r.n for r in rows if r.what == "s"}
    words: dict[str, dict[str, float]] = defaultdict(dict)
    ratios: dict[str, dict[int, int]] = defaultdict(dict)
    for r in rows:
        if r.what == "w":
            words[r.lang][r.word] = r.n / r.total
        elif r.what == "r":
            ratios[r.lang][int(r.word)] = r.n
    copied_rows = counts.where("what = 'c'").join(kept.where("what = 's'").select("word"), "word", "left_semi").collect()
    copies = {r.word: r.n for r in copied_rows}
    copied = {w: copies.get(w, 0) / n for w, n in sources.items()}
    usual = {}
    for langs, hist in ratios.items():
        half, seen = sum(hist.values()) / 2, 0
        for k in sorted(hist):
            seen += hist[k]
            if seen >= half:
                usual[langs] = max(0.05, (k + 0.5) / 100)
                break
    return Corpus(dict(words), copied, usual)


def pair_defects(pairs: DataFrame) -> DataFrame:
    """(rec_table, rec_id, defect) of the defective pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast(corpus_of(pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = shared.value
        for x in batches:
            x["defect"] = [defect_of(s or "", t or "", a or "", b or "", corpus) for s, t, a, b in zip(x.source, x.target, x.src, x.tgt)]
            yield x.loc[x.defect.notna(), ["rec_table", "rec_id", "defect"]]

    return pairs.mapInPandas(run, "rec_table string, rec_id long, defect string")
