import pytest

from weftwork.llm import consistent, defects, garbled, sentences

SEG = "id long, file_id long, source string, target string, state string, text string, rec_table string, row long"
TM = "id long, src_lang string, tgt_lang string, source string, target string, text string, kinds string, word string"
FILE = "id long, project_id long, kind string, original string, text string, token string"


def segments(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SEG)


def units(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TM)


def files(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], FILE)


# --- one form


@pytest.mark.parametrize(
    "text,want,kinds",
    [
        ("Ｆｉｔ the ３ bolts", "Fit the 3 bolts", ["full_width"]),
        ("café й", "café й", ["mark"]),
        ("ser​ver﻿", "server", ["invisible"]),
        ("a b　c", "a b c", ["space"]),
        ("a\tb\nc “d” – e… 《中》，", "a\tb\nc “d” – e… 《中》，", []),
        ("फ़िल्टर ज़", "फ़िल्टर ज़", []),
        ("слово word слово-word", "слово word слово-word", []),
    ],
)
def test_plain_form(text, want, kinds):
    assert consistent.plain_form(text) == (want, kinds)
    assert not consistent.mixed_tokens(want)


def test_look_alikes_go_by_the_vocabulary(spark):
    rows = [(1, "en", "ru", "the server stops", "сервер стоит"), (2, "en", "ru", "the sеrvеr stops", "cервер"), (3, "en", "ru", "zzаq", None), (4, "en", "ru", "", "中文Kаz"), (4, "en", "ru", "", "中文Kаz")]
    seg = segments(spark, [(1, 1, "x", "Kaz ｋ", "draft"), (2, 1, "x", None, "new")])
    fields = consistent.fields_of(seg, units(spark, rows))
    got = {(r.rec_table, r.rec_id, r.field): (r.text, r.kinds) for r in consistent.consistent_form(fields).collect()}
    assert consistent.consistent_form(fields).count() == fields.count() == 12
    assert got["tm_units", 2, "source"] == ("the server stops", ["look_alike"]) and got["tm_units", 2, "target"] == ("сервер", ["look_alike"])
    assert got["tm_units", 3, "source"] == ("zzаq", ["look_alike"]) and got["tm_units", 3, "target"] == (None, [])
    assert got["tm_units", 4, "source"] == ("", []) and got["segments", 1, "target"] == ("Kaz k", ["full_width"])
    found = consistent.out_of_form(seg, units(spark, rows))
    assert sorted(map(tuple, found.collect())) == [("segments", 1, "target"), ("tm_units", 2, "source"), ("tm_units", 2, "target"), ("tm_units", 3, "source"), ("tm_units", 4, "target"), ("tm_units", 4, "target")]
    assert consistent.out_of_form(segments(spark, []), units(spark, [])).count() == 0


def test_vocabulary_covers_rows_that_are_out_of_form(spark):
    """The proper words stand only in rows with a no-break space, a full-width or invisible character, a loose mark or a mixed word."""
    proper = ["le serveur", "ｐump", "val​ve", "café", "motor zzаq"]
    bad = ["sеrveur", "pumр", "vаlve", "cаfé", "mоtor", "zzаq"]
    rows = [(n, "en", "fr", "", t) for n, t in enumerate(proper + bad)]
    got = {r.rec_id: r.text for r in consistent.consistent_form(consistent.fields_of(segments(spark, []), units(spark, rows))).where("field = 'target'").collect()}
    assert [got[len(proper) + n] for n in range(len(bad))] == ["serveur", "pump", "valve", "café", "motor", "zzаq"]
    assert {r.word for r in consistent.vocabulary(consistent.fields_of(segments(spark, []), units(spark, rows))).collect()} == {"le", "serveur", "pump", "valve", "café", "motor"}


def test_very_long_text_is_read_whole():
    import pyarrow as pa

    assert consistent.suspects(pa.array(["a" * 300_000 + "​", "b" * 300_000, "", None])).tolist() == [True, False, False, False]


# --- garbled text

CLEAN = ["Проверьте насос перед пуском", "Größe und Maß der Öse", "le café naïf coûte 5 €", "“Stop!” — il a crié", "请检查阀门", "การตรวจ วาล์ว", "افحص الصمام", "ポンプを確認"]


def records(spark, texts):
    return garbled.records_of(files(spark, []), segments(spark, [(n, 1, t, "", "new") for n, t in enumerate(texts)]))


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1252", "mac_roman")])
def test_chains_invert(chain):
    for text in CLEAN:
        bad = garbled.garble(text, chain)
        if bad is not None and bad != text and "�" not in bad:
            assert garbled.restore(bad, chain) == text


def test_garbled_records_are_found_and_restored(spark):
    clean = CLEAN * 6
    bad = [garbled.garble(t, ("utf-8", "cp1252")) for t in CLEAN] + [garbled.garble(CLEAN[0], ("koi8-r", "cp1251")), garbled.garble(CLEAN[1], ("cp1252", "mac_roman")), "le caf� na�f co�te 5 �", "????????? ????? ????? ??????"]
    quiet = ["The keys “Ã” and “Â” do nothing", "What does “???” mean?", "", "Was it a caf?", "plain"]
    texts = clean + bad + quiet
    found = {r.rec_id for r in garbled.find_garbled(records(spark, texts)).collect()}
    assert found == set(range(len(clean), len(clean) + len(bad)))
    back = {r.rec_id: r.restored for r in garbled.restored(records(spark, texts)).collect()}
    assert set(back) == found
    for n, text in enumerate(CLEAN):
        assert back[len(clean) + n] == text
    assert back[len(clean) + len(CLEAN)] == CLEAN[0]


def test_long_words_and_every_double_chain(spark):
    long = "Donaudampfschifffahrtsgesellschaftskapitän"
    run = "ท่อ" * 120
    texts = [f"{long} Größe {run}"] * 30 + [garbled.garble(long, ("utf-8", "cp1252")), garbled.garble(run, ("utf-8", "cp1252"))]
    doubles = [("utf-8", a, "utf-8", b) for a in ("iso8859-15", "cp1256", "mac_cyrillic") for b in ("koi8-r", "cp437", "iso8859-5")]
    texts += [garbled.garble("Größe", c) for c in doubles]
    assert {r.rec_id for r in garbled.find_garbled(records(spark, texts)).collect()} == set(range(30, len(texts)))
    back = {r.rec_id: r.restored for r in garbled.restored(records(spark, texts)).collect()}
    assert [back[30 + n] for n in range(2 + len(doubles))] == [long, run] + ["Größe"] * len(doubles)


def test_filter_holds_every_word(spark):
    import xxhash

    words = [f"wört{n}" for n in range(9000)]
    bits = garbled.filter_of(spark.createDataFrame([(w,) for w in words], "token string"), len(words))
    at = lambda w: xxhash.xxh64_intdigest(w, seed=42) & (len(bits) * 8 - 1)
    assert len(bits) * 8 == 1 << 18 and all(bits[at(w) >> 3] >> (at(w) & 7) & 1 for w in words)
    assert sum(bits[at(w + "x") >> 3] >> (at(w + "x") & 7) & 1 for w in words) < 600
    assert not any(garbled.filter_of(spark.createDataFrame([], "token string"), 0))


def test_garbled_edge_cases(spark):
    assert garbled.find_garbled(records(spark, [])).count() == 0
    rows = garbled.records_of(files(spark, [(1, 1, "txt", None), (2, 1, "txt", "é " * 50_000 + "Ã©t\xc3\xa9 "), (None, 1, "txt", "été")]), segments(spark, [(1, 1, None, "", "new"), (2, 1, "été été", "", "new"), (2, 1, "été été", "", "new")]))
    assert {(r.rec_table, r.rec_id) for r in garbled.find_garbled(rows).collect()} == {("files", 2)}


# --- sentences

NONE = sentences.Answers({}, set())


@pytest.mark.parametrize(
    "parts",
    [
        ["Ask Dr. Mordale about it, i.e. the unit.", "See Fig. 14 and p. 227 for X vs. Y.", "“Is it ready?” asked J. R. Lorcroft.", "eNova65 starts on its own."],
        ["The label reads “Stop! Do not open.” in red.", "Wait ... then press the key again!", "Prof. Ulm wrote: “It works. It always has.”", "Does version 8.15.7 cost 29.7 euros?!", "47 bolts (approx. 4.5 mm) hold."],
        ["Спросите д-ра Лазрука, т.е. про узел 20,1 мм.", "«Готов ли он?» — спросил И. П. Лазрук.", "См. рис. 53 и стр. 290."],
        ["Version 1.2 erschien am 3. Mai um 17 Uhr.", "Auf dem Schild steht „Halt! Nicht öffnen.“ in Rot."],
        ["Sur la plaque on lit « Stop ! Ne pas ouvrir. » en rouge.", "Est-ce qu’il pèse 4,5 kg ?!"],
    ],
)
def test_latin_and_cyrillic_sentences(parts):
    for gap in (" ", "  ", "\n", "\n\n", " \r\n \r\n"):
        text = gap.join(parts)
        assert [text[a:b] for a, b in sentences.sentences(text, NONE)] == parts


@pytest.mark.parametrize(
    "parts,gap",
    [
        (["标签上写着：“停！请勿打开。”，因此请等待。", "如果出错，请联系我们……", "真的售价35.2欧元吗？！"], ""),
        (["札には「停止！開けるな。」とあるので、待ってください。", "図62（11ページ）を参照し、切ってください。"], ""),
        (["डॉ. की टीम ने बदला।", "चित्र 6 (पृ. 127) देखें; फिर बंद करें॥", "क्या यह क्र. 4 है?"], " "),
        (["هل هو 21.1 يورو حقا؟!", "انظر الشكل 65 (ص. 43)؛ ثم أطفئ فورا.", "افحص الصمام."], " "),
        (["ช่างเปลี่ยนไส้กรอง 39 ชิ้นแล้วส่งรหัส GD-7 กลับคลังสินค้า", "ดูรูปที่ 65 หน้า 207 ทันที"], " "),
    ],
)
def test_other_scripts(parts, gap):
    text = gap.join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text, NONE)] == parts


def test_document_decides_about_abbreviations():
    one = "We use the Zab. of steel here. Then the Zab. Kolm fails."
    assert len(sentences.sentences(one, NONE)) == 2
    two = "We use the zab to hold it. Open the zab. Kolm fails."
    assert len(sentences.sentences(two, NONE)) == 3


def test_document_decides_about_long_abbreviations():
    assert len(sentences.sentences("Preis einschl. der Pumpe. Preis einschl. Montage.", NONE)) == 2
    assert len(sentences.sentences("Preis einschl. Montage. Kolm", NONE)) == 3


@pytest.mark.parametrize(
    "text,counts,want",
    [
        # the document's own word without a full stop counts before any list
        ("The answer was no. We left the room early, and no one asked why.", {}, 2),
        ("See no. 5 for it. There was no. 6 left, no?", {}, 2),
        # lists hold for their own language only
        ("She likes modern art. The gallery is open.", {}, 2),
        ("Selon art. 5 de la loi, le bail est clos.", {}, 1),
        # long words: document, then corpus
        ("Siehe Abschn. drei und Abschn. vier. Nach Abschn. 4 gilt die Frist.", {}, 2),
        ("Nach Abschn. 4 gilt die Frist.", {("abschn", "d"): 100}, 1),
        ("Er kam am Montag. 4 Leute warteten.", {("montag", "d"): 3, ("montag", "e"): 10}, 2),
        # a word that the corpus writes without a full stop as well is none, unless a number follows
        ("Look at the sect. Kolm is there.", {("sect", "l"): 9}, 1),
        ("Look at the sect. Kolm is there, as every sect knows.", {("sect", "l"): 9}, 2),
    ],
)
def test_document_then_corpus_then_lists(text, counts, want):
    assert len(sentences.sentences(text, sentences.Answers(counts, set()))) == want


def test_words_before_capitals_need_evidence_by_length():
    many = lambda w, n: sentences.Answers({(w, "u"): n}, set(), {}, {w: n})
    for word, short, enough in (("Hw", 7, 8), ("Hauptwerkstatt", 17, 19)):
        text = f"Frage {word}. Kolm danach."
        assert len(sentences.sentences(text, many(word.lower(), short))) == 2
        assert len(sentences.sentences(text, many(word.lower(), enough))) == 1
    assert len(sentences.sentences("Frage Hw. Kolm danach.", sentences.Answers({("hw", "u"): 40, ("hw", "e"): 20}, set(), {}, {"hw": 40}))) == 2


def test_stops_in_quotation_marks_are_no_evidence():
    assert sentences._stops_in("On it: “It works. It has.” Then approx. 5 (cf. 6).") == [("approx", "d"), ("cf", "d")]


def test_sentences_cover_all_text_and_nothing_twice(spark):
    texts = ["Title\n\nIt works. Good so", " \n ", "", None, "It works. " * 20_000, "(a. B", "“open. Never closed", "no stop 😀. Next 😀!"]
    docs = spark.createDataFrame([("t", n, t) for n, t in enumerate(texts)], "rec_table string, rec_id long, text string")
    got = {}
    for r in sentences.split_sentences(docs).collect():
        got.setdefault(r.rec_id, []).append((r.start_pos, r.end_pos))
    for n, text in enumerate(texts):
        spans = sorted(got.get(n, []))
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join((text or "").split())
        assert all(text[a:b] == text[a:b].strip() and b > a for a, b in spans)
    assert len(got[0]) == 3 and len(got[4]) == 20_000 and 1 not in got
    assert sentences.split_sentences(docs.limit(0)).count() == 0


def test_rare_words_of_a_great_corpus_have_their_say(spark):
    """More than 100,000 stops: words and counts below the share that is sent to every task."""
    texts = ["Go now. " * 1000] * 450
    texts += ["Use the zab. here"] * 3 + ["The Tor. Kolm fails."] * 7 + ["Open the Tor."] + ["so meist here"] * 2
    asked = {"We use the Zab. Kolm fails.": 1, "The Tor. Kolm fails.": 2, "See x. Meist fails.": 2, "See x. Kolm fails.": 1}
    docs = spark.createDataFrame([("t", n, t) for n, t in enumerate([*texts, *asked])], "rec_table string, rec_id long, text string").repartition(4)
    got = {r.rec_id: r["count"] for r in sentences.split_sentences(docs).groupBy("rec_id").count().collect()}
    assert [got[len(texts) + n] for n in range(len(asked))] == list(asked.values())
    assert got[0] == 1000


def test_garbled_records_have_no_sentences(spark):
    seg = segments(spark, [(n, 1, t, "", "new") for n, t in enumerate(["Größe. Maß."] * 5 + ["GrÃ¶ÃŸe. MaÃŸ."])])
    got = sentences.clean_sentences(files(spark, [(1, 1, "xliff", "A. B."), (2, 1, "pdf", "A b.\nC d."), (3, 1, "txt", None)]), seg)
    assert sorted({(r.rec_table, r.rec_id) for r in got.collect()}) == [("files", 2), *[("segments", n) for n in range(5)]]


# --- defective pairs

SOURCES = [f"Fit the sensor of Kapudit{n} to Zoferal{n} with tool KT-{315871 + n}, once Tulokip confirms ticket {220000 + n}." for n in range(30)]
TARGETS = [f"Bevestig de sensor van Kapudit{n} aan Zoferal{n} met gereedschap KT-{315871 + n}, zodra Tulokip ticket {220000 + n} bevestigt." for n in range(30)]
S, T = SOURCES[0], TARGETS[0]
RUSSIAN = "Установите датчик изделия Kapudit0 на Zoferal0 инструментом KT-315871, когда Tulokip подтвердит заявку 220000."


@pytest.mark.parametrize(
    "source,target,want",
    [
        (S, T, None), (S, T[:-1], None), (S, T.replace("sensor", "sensro"), None), (S, T.replace("van ", ""), None), (S, T.upper(), None), (S, "  " + T + "\n", None),
        (S, None, "empty"), (S, "<x id='1'/> —", "empty"), (S, "[ ]", "empty"), (None, "", "empty"),
        (S, "I’m sorry, but I can’t translate this segment.", "refusal"), (S, "Helaas mag ik niet helpen met uw verzoek.", "refusal"), (S, "К сожалению, я не могу перевести этот текст.", "refusal"),
        (S, S, "copy"), (S, S.lower(), "copy"), (S, f"[NL] {S}", "copy"), (S, f"{S[:-1]} (en)", "copy"), ("Open Kapudit", "Open Kapudit", None),
        (S, RUSSIAN, "wrong_language"),
        (S, T[:60], "truncated"), (S, T[:52] + " -", "truncated"), (S, T[: len(T) // 2] + "...", "truncated"),
        ("Sorry, Kapudit could not read it.", "Sorry, Kapudit kon het niet lezen.", None),
    ],
)
def test_defects(corpus, source, target, want):
    assert defects.defect_of(source or "", target or "", "en", "nl", corpus) == want


@pytest.mark.parametrize("text", ["The taxi cannot take this text.", "Wifi cannot carry the request.", "Mini can't process this file.", "Le saje ne peux pas ce texte.", "Der Stich kann nicht helfen."])
def test_words_that_end_like_a_phrase_do_not_decline(text):
    assert not defects.declines(text)


@pytest.mark.parametrize("text", ["I cannot translate this text.", "(I can’t help with that)", "Sorry. I won't render this sentence.", "我无法翻译这段文本", "申し訳ありませんが、翻訳できません。依頼", "ขออภัยไม่สามารถแปลข้อความนี้", "Ich kann diesen Text leider nicht übersetzen."])
def test_refusals_of_every_script(text):
    assert defects.declines(text)


def test_copies_of_one_character_and_without_languages(corpus):
    assert defects.defect_of("停", "停", "zh", "en", corpus) == "copy" and defects.defect_of("停。", "停！", "ja", "nl", corpus) == "copy"
    assert defects.defect_of(S, S, "", "", corpus) == "copy" and defects.defect_of(S, S, "en", "en", corpus) is None


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(n, "en", "nl", s, t) for n, (s, t) in enumerate(zip(SOURCES, TARGETS))] + [(100 + n, "en", "ru", s, RUSSIAN.replace("Kapudit0", f"Kapudit{n}")) for n, s in enumerate(SOURCES)]
    return defects.corpus_of(defects.pairs_of(units(spark, rows), segments(spark, []), files(spark, []), projects(spark)))


def projects(spark):
    return spark.createDataFrame([(1, "zh_CN", "EN")], "id long, src_lang string, tgt_lang string")


def test_finished_segments_and_all_units_are_judged(spark):
    seg = segments(spark, [(1, 1, "请检查", "请检查", "approved"), (2, 1, "请检查", None, "translated"), (3, 1, "请检查", "", "new"), (4, 9, "x", "", "approved"), (4, 9, "x", "", "approved")])
    tm = units(spark, [(1, None, None, None, None), (2, "en", "nl", S, T)])
    pairs = defects.pairs_of(tm, seg, files(spark, [(1, 1, "txt", None)]), projects(spark))
    got = sorted(map(tuple, defects.pair_defects(pairs).collect()))
    assert got == [("segments", 1, "copy"), ("segments", 2, "empty"), ("segments", 4, "empty"), ("segments", 4, "empty"), ("tm_units", 1, "empty")]
    assert defects.pair_defects(pairs.limit(0)).count() == 0


def test_suffix_automaton_finds_every_run():
    import random

    r = random.Random(2)
    for _ in range(200):
        a, b = r.choices("abc", k=r.randint(0, 9)), r.choices("abcd", k=r.randint(0, 9))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        for least in (1, 2, 3):
            hit = {k for i in range(len(b)) for j in range(i + least, len(b) + 1) if tuple(b[i:j]) in runs for k in range(i, j)}
            assert defects.SuffixAutomaton(a).covered(b, least) == len(hit)
