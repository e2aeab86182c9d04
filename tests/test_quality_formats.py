import importlib.util

import pytest
from pyspark.sql import functions as F

from weftwork.operators import align, quality
from weftwork.sources import plain, tmx, xliff

PAIR = "id long, source string, target string, src_lang string, tgt_lang string"

X12 = """<?xml version="1.0" encoding="UTF-8"?>
<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file original="a" source-language="en" datatype="plaintext"><body>
<trans-unit id="1"><source>Press <g id="1" x="a&amp;b">OK</g> &amp; go.</source></trans-unit>
<group><trans-unit id="2"><source>Weight 42.5</source><target state="signed-off">Вес 42,5</target></trans-unit></group>
<trans-unit id="3" translate="no"><source>no</source></trans-unit><trans-unit id="4"/></body></file></xliff>"""
X20 = """<xliff version="2.0" srcLang="en" trgLang="nl" xmlns="urn:oasis:names:tc:xliff:document:2.0"><file id="f"><unit id="u1">
<segment id="s1" state="reviewed"><source>Hello</source><target>Hallo</target></segment><segment><source>Bye</source></segment></unit></file></xliff>"""


def codes(spark, source, target, src="en", tgt="ru"):
    rows = quality.issues(spark.createDataFrame([(1, source, target, src, tgt)], PAIR)).orderBy("place").collect()
    return [r.code for r in rows]


@pytest.mark.parametrize(
    "source,target,tgt,want",
    [
        ("Hello", None, "ru", ["empty"]),
        ("Hello", " 　", "ru", ["empty"]),
        ("Weight 42.5 kg.", "Вес 42,5 кг.", "ru", []),
        ("Weight 42.5 kg.", "Вес 43 кг.", "ru", ["numbers"]),
        ("This is the text.", "This is the text.", "ru", ["untranslated"]),
        ("<b>Go</b> now.", "<b>Иди.", "ru", ["tags"]),
        ("Go now.", " Иди  сейчас", "ru", ["whitespace", "double_space", "punct_end"]),
        ("Go now to the house there", "Иди", "ru", ["length"]),
        ("Go now.", "Иди иди сейчас.", "ru", ["repeated_word"]),
        ("Go now.", "иди сейчас.", "ru", ["capitalization"]),
        ("Go now.", 'Иди "сейчас" - да.', "ru", ["ru_quotes", "ru_dash"]),
        ("Go now.", "Cейчас.", "ru", ["ru_mixed_script"]),
        ("Go now to the house.", "Een komma splitsing, u heeft.", "nl", ["nl_compound", "nl_style"]),
        ("", "Иди", "ru", ["punct_end"]),
    ],
)
def test_quality_rules(spark, source, target, tgt, want):
    assert codes(spark, source, target, tgt=tgt) == want


def test_glossary_and_omission(spark):
    pairs = spark.createDataFrame([(1, "The sensor (big) works", "Прибор работает", "en", "ru"), (2, "Sensors", "x", "en", "ru"), (3, "a sensor", "ДАТЧИК", "en", "ru")], PAIR)
    terms = spark.createDataFrame([("en", "ru", "Sensor", "датчик"), ("en", "ru", "(big)", "большой")], "src_lang string, tgt_lang string, src_term string, tgt_term string")
    assert {(r.id, r.src_term) for r in quality.glossary_issues(pairs, terms).collect()} == {(1, "Sensor"), (1, "(big)")}
    lex = spark.createDataFrame([("en", "ru", "sensor", "датчик", 0.9), ("en", "ru", "works", "работает", 0.9)], "src_lang string, tgt_lang string, src_word string, tgt_word string, prob double")
    assert {(r.id, r.words) for r in quality.omissions(pairs, lex).collect()} == {(1, "sensor")}


def test_sentences(spark):
    texts = ["Dr. Smith came at 5 p.m. today. He left! Was it good?\n\nA new paragraph", "Это т.д. и т.п. слова. Новое.", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in plain.sentences(docs).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.source)
    assert got == {0: ["Dr. Smith came at 5 p.m. today.", "He left!", "Was it good?", "A new paragraph"], 1: ["Это т.д. и т.п. слова.", "Новое."]}


def test_xliff_units_and_round_trip(spark):
    units = xliff.units_in(X12)
    assert units == [("1", 'Press <g id="1" x="a&amp;b">OK</g> &amp; go.', "", "new"), ("2", "Weight 42.5", "Вес 42,5", "translated")]
    assert xliff.units_in(X20) == [("u1//s1", "Hello", "Hallo", "translated"), ("u1//1", "Bye", "", "new")]
    assert xliff.units_in("<no") == [] and xliff.units_in(None) == [] and xliff.units_in("<!DOCTYPE x><x/>") == []
    out = xliff.with_translations(X12, {"1": ('Нажмите <g id="1">ОК</g>', "approved"), "2": ("A & <b", "draft")}, "ru")
    assert xliff.units_in(out)[:2] == [("1", 'Press <g id="1" x="a&amp;b">OK</g> &amp; go.', 'Нажмите <g id="1">ОК</g>', "translated"), ("2", "Weight 42.5", "A &amp; &lt;b", "draft")]
    assert 'target-language="ru"' in out and out.index("<source>Press") < out.index("<target") < out.index("Weight")
    assert xliff.units_in(xliff.with_translations(X20, {"u1//1": ("Doei", "approved")}))[1] == ("u1//1", "Bye", "Doei", "translated")
    made = xliff.from_sentences(["A & B", "C"], 'a "b".txt', "en", "nl")
    assert [u[1] for u in xliff.units_in(made)] == ["A &amp; B", "C"]
    files = spark.createDataFrame([(1, X12), (2, None), (3, "bad")], "id long, original string")
    assert {(r.file_id, r.seq, r.unit_id) for r in xliff.units(files).collect()} == {(1, 1, "1"), (1, 2, "2")}


def test_xliff_changes_only_what_it_must(spark):
    doc = """<?xml version='1.0' encoding="UTF-16"?>
<x:xliff xmlns:x="urn:x" version="1.2"><!-- kept --><x:file original='f' target-language="nl"><x:body><x:group>
  <x:trans-unit id="a"><x:source>One <x:g id="1">two</x:g></x:source><x:alt-trans><x:source>no</x:source><x:target>no</x:target></x:alt-trans></x:trans-unit>
  <x:trans-unit id="b"><x:source/><x:target state='new' note="x > y"/></x:trans-unit></x:group></x:body></x:file></x:xliff>"""
    assert xliff.units_in(doc) == [("a", 'One <g id="1">two</g>', "", "new"), ("b", "", "", "new")]
    out = xliff.with_translations(doc, {"a": ('Een <g id="1">twee</g>', "translated"), "b": ("", "approved")}, "ru")
    assert "<!-- kept -->" in out and 'target-language="nl"' in out and """<x:target note="x > y" state="final"></x:target>""" in out.replace("""state="final" note="x > y\"""", """note="x > y" state="final\"""")
    assert xliff.units_in(out) == [("a", 'One <g id="1">two</g>', 'Een <g id="1">twee</g>', "translated"), ("b", "", "", "translated")]
    two = """<xliff version="2.0" srcLang="en" trgLang="nl"><file id="f"><unit id="u"><segment id="s"><source>A</source><ignorable/></segment><segment/></unit></file></xliff>"""
    out = xliff.with_translations(two, {"u//s": ("B", "approved"), "u//1": ("C]]>", "draft")})
    assert '<segment id="s" state="final"><source>A</source><ignorable/><target>B</target></segment>' in out and "<segment><target>C]]&gt;</target></segment>" in out


def test_xliff_files_without_translations_are_written_too(spark):
    files = spark.createDataFrame([(1, 1, "xliff", X12), (2, 1, "xliff", X12), (3, None, "xliff", X12), (4, 1, "txt", "x"), (5, 1, "xliff", "bad")], "id long, project_id long, kind string, original string")
    rows = [(1, 1, 1, "1", "eins", "draft"), (2, 1, 2, "1", "zwei", "approved"), (3, 1, 3, "2", None, "new"), (4, 2, 1, "1", "", "new"), (5, 2, 2, "", "x", "draft")]
    seg = spark.createDataFrame(rows, "id long, file_id long, seq int, unit_id string, target string, state string")
    docs = {r.file_id: xliff.units_in(r.content) for r in xliff.written(files, seg, spark.createDataFrame([(1, "de")], "id long, tgt_lang string")).collect()}
    assert set(docs) == {1, 2, 3}
    assert [u[2:] for u in docs[1]] == [("zwei", "translated"), ("", "translated")] and [u[2:] for u in docs[2]] == [u[2:] for u in docs[3]] == [("", "new"), ("Вес 42,5", "translated")]


def pairs_in(spark, doc, src, tgt):
    docs = spark.createDataFrame([(1, doc, src, tgt)], "doc_id long, content string, src_lang string, tgt_lang string")
    return [(r.source, r.target) for r in tmx.pairs(docs).orderBy("place").collect()]


def test_tmx(spark, tmp_path):
    doc = """<tmx version="1.4"><header/><body><tu><tuv xml:lang="en"><seg>lamp</seg></tuv><tuv xml:lang="ru"><seg>лампа</seg></tuv></tu>
    <tu><tuv xml:lang="en-US"><seg>a <bpt i="1">b</bpt>plug</seg></tuv><tuv lang="nl_NL"><seg> een  stekker </seg></tuv><tuv lang="nl"><seg>later</seg></tuv></tu></body></tmx>"""
    assert pairs_in(spark, doc, "en", "ru") == [("lamp", "лампа")] and pairs_in(spark, doc, "ru", "en") == [("лампа", "lamp")]
    assert pairs_in(spark, doc, "en", "nl") == [("a bplug", "een stekker")] and pairs_in(spark, "oops", "en", "nl") == []
    docs = spark.createDataFrame([(1, doc, "en", "ru")], "doc_id long, content string, src_lang string, tgt_lang string")
    assert tmx.pairs(docs, both_directions=True).count() == 2
    mem = spark.createDataFrame([(n, "en", "ru", f"A & <B> {n}", f"А и Б {n}") for n in range(9)], "id long, src_lang string, tgt_lang string, source string, target string")
    line = tmx.unit_lines(mem).orderBy("id").first().line
    assert pairs_in(spark, tmx.head("en", "x") + line + tmx.FOOT, "en", "ru") == [("A & <B> 0", "А и Б 0")]
    tmx.write(mem, str(tmp_path / "out"), "en", "ru", "20240101T000000Z", 4)
    read = [pairs_in(spark, p.read_text(), "en", "ru") for p in (tmp_path / "out").glob("part=*/*.txt")]
    assert len(read) > 1 and sorted(x for r in read for x in r) == sorted((f"A & <B> {n}", f"А и Б {n}") for n in range(9))


def best_by_force(source, target):
    """(cost, runs) by trying every way."""
    import math
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j):
        if not i and not j:
            return 0.0, ()
        found = []
        for di, dj in ((2, 1), (1, 2), (1, 1)):
            if i >= di and j >= dj and best(i - di, j - dj):
                ls, lt = sum(source[i - di : i]), sum(target[j - dj : j])
                cost, runs = best(i - di, j - dj)
                found.append((cost + (10.0 if not ls or not lt else abs(math.log(ls / lt)) + 0.4 * (di + dj - 2)), runs + ((di, dj),)))
        return min(found, key=lambda f: f[0]) if found else None

    return best(len(source), len(target))


def test_beads_are_the_best_ones(monkeypatch):
    import random
    import time

    r = random.Random(9)
    monkeypatch.setattr(align, "KEPT", 4)
    for _ in range(150):
        a, b = ([r.randint(0, 60) for _ in range(r.randint(1, 9))] for _ in "ab")
        want, got = best_by_force(tuple(a), tuple(b)), align.beads(a, b)
        runs = tuple((y - x, v - u) for x, y, u, v in got)
        assert runs == (want[1] if want else ((1, 1),) * min(len(a), len(b)))
    monkeypatch.undo()
    began = time.time()
    a = [r.randint(5, 200) for _ in range(1500)]
    assert align.beads(a, a) == [(i, i + 1, i, i + 1) for i in range(1500)] and time.time() - began < 20


def test_alignment(spark):
    docs = [(1, "One.\nTwo.", "Один.\nДва."), (2, "A first sentence here. Second one! Third is here now.", "Первое предложение здесь. Второе! Третье теперь здесь."), (3, "", "x"), (4, None, None), (5, "A. B. C. D. E.", "X.")]
    got = {}
    for r in align.aligned(spark.createDataFrame(docs, "pair_id long, s_text string, t_text string")).orderBy("pair_id", "place").collect():
        got.setdefault(r.pair_id, []).append((r.source, r.target))
    assert got[1] == [("One.", "Один."), ("Two.", "Два.")] and len(got[2]) == 3 and 3 not in got and 4 not in got
    assert align.beads([10, 10, 20], [20, 20]) == [(0, 2, 0, 1), (2, 3, 1, 2)]
    assert align.beads([5] * 5, [5]) == [(0, 1, 0, 1)]


def test_text_export_and_optional_pdf(spark):
    seg = spark.createDataFrame([(1, 1, 2, "b", ""), (2, 1, 1, "a", "x"), (3, 1, 3, "c", None)], "id long, file_id long, seq int, source string, target string")
    assert plain.exported(seg).first().content == "x\nb\nc"
    if importlib.util.find_spec("pypdf") is None:
        with pytest.raises(ImportError):
            plain.read_pdf(spark, "/nowhere")


def test_long_documents_align_in_little_time():
    import random
    import time

    r = random.Random(11)
    a = [max(3, int(r.gauss(90, 30))) for _ in range(6000)]
    b = [max(1, int(x * r.gauss(1.1, 0.15))) for x in a]
    b[3000:3001] = [b[3000] // 2, b[3000] - b[3000] // 2]
    began = time.time()
    found = align.beads(a, b)
    assert time.time() - began < 6 and found[0] == (0, 1, 0, 1) and found[-1] == (5999, 6000, 6000, 6001)
    assert all(x[1] == y[0] and x[3] == y[2] for x, y in zip(found, found[1:]))
