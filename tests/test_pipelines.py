import pytest

from weftwork.operators import memory, pipelines
from weftwork.sources import services, tmx, upload
from weftwork.streaming import learning

SCHEMA = "id long, src_lang string, tgt_lang string, source string, target string, origin string, use_count long, updated_at timestamp"


def units(spark, *pairs):
    return spark.createDataFrame([(n, "en", "ru", s, t, "manual", 0, None) for n, (s, t) in enumerate(pairs, 1)], SCHEMA)


def test_guards():
    assert pipelines.check_pair("EN_us", " ru") == ("en", "ru") and pipelines.check_pair("xx", "yy", {("xx", "yy")})
    with pytest.raises(ValueError):
        pipelines.check_pair("en", "fr")
    with pytest.raises(ValueError):
        pipelines.check_state("done")
    assert pipelines.check_state("draft") == "draft"


def test_tmx_import_both_ways_counts_repeats(spark):
    doc = tmx.head("en", "x") + '<tu><tuv xml:lang="en"><seg>lamp</seg></tuv><tuv xml:lang="ru"><seg>лампа</seg></tuv></tu>' * 2 + tmx.FOOT
    docs = spark.createDataFrame([(1, doc, "en", "ru")], "doc_id long, content string, src_lang string, tgt_lang string")
    got = {(r.src_lang, r.source, r.target, r.origin, r.use_count) for r in pipelines.import_tmx(units(spark, ("lamp", "лампа")), docs).collect()}
    assert got == {("en", "lamp", "лампа", "manual", 2), ("ru", "лампа", "lamp", "tmx", 1)}


def test_document_pairs_teach_memory_and_lexicon(spark):
    text = [(f"{a} {n}", f"{b} {n}") for a, b in (("open", "открыть"), ("close", "закрыть")) for n in (7, 8)]
    docs = spark.createDataFrame([(1, "en", "ru", "\n".join(a for a, _ in text), "\n".join(b for _, b in text))], "pair_id long, src_lang string, tgt_lang string, s_text string, t_text string")
    mem, words = pipelines.import_documents(units(spark), docs)
    assert mem.count() == 4 and {r.origin for r in mem.collect()} == {"corpus"} and words.count() > 0


def test_panel(spark):
    seg = spark.createDataFrame([(1, "en", "ru", "the red dog sleeps"), (2, "en", "ru", "zzz"), (3, "en", "ru", None)], "id long, src_lang string, tgt_lang string, source string")
    lex = spark.createDataFrame([("en", "ru", "dog", "собака", 0.9)], "src_lang string, tgt_lang string, src_word string, tgt_word string, prob double")
    got = {r.id: r for r in pipelines.panel(seg, memory.upsert_units(units(spark, ("the red cat sleeps", "рыжий кот спит"))), lex).collect()}
    assert len(got) == 3 and got[1].matches[0].percent == 75 and got[1].terms == {"dog": "собака"} and got[1].suggestion.percent == 75
    assert got[2].matches is None and got[2].suggestion is None and got[3].terms is None


def test_deletion_takes_all_that_belongs(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    f = spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id long, project_id long")
    s = spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "id long, file_id long")
    left = [sorted(r.id for r in x.collect()) for x in pipelines.without_project(1, p, f, s)]
    assert left == [[2], [20, 30], [200, 300]]


def test_terms_are_added_once(spark):
    g = spark.createDataFrame([(1, "en", "ru", "sensor", "датчик")], "id long, src_lang string, tgt_lang string, src_term string, tgt_term string")
    new = spark.createDataFrame([("EN", "ru", " sensor ", "датчик"), ("en", "ru", "plug", "штекер"), ("en", "ru", "plug", "штекер"), ("en", "ru", " ", "x")], "src_lang string, tgt_lang string, src_term string, tgt_term string")
    assert sorted(r.src_term for r in pipelines.with_terms(g, new).collect()) == ["plug", "sensor"]


def test_upload_by_extension(spark):
    docs = [(1, "a.XLF", b'<xliff version="1.2"><file><body><trans-unit id="u"><source>A</source><target state="final"/></trans-unit></body></file></xliff>'), (2, "b.txt", "First & one. Second!\n\n\xc9t\xe9".encode() + b"\xff")]
    got = {(r.id, r.seq): (r.unit_id, r.source, r.state) for r in upload.units(spark.createDataFrame(docs, "id long, name string, content binary")).collect()}
    assert got[1, 1] == ("u", "A", "new") and got[2, 1] == ("1", "First &amp; one.", "new") and got[2, 2][1] == "Second!" and got[2, 3][1].startswith("Été")
    with pytest.raises(Exception, match="unknown kind"):
        upload.units(spark.createDataFrame([(1, "a.doc", b"")], "id long, name string, content binary")).collect()


def test_upload_refuses_what_gives_no_unit(spark):
    import importlib.util

    docs = lambda *rows: spark.createDataFrame(list(rows), "id long, name string, content binary")
    for name, content in (("a.xliff", b"<xliff version='1.2'/>"), ("b.xlf", b"no xml"), ("c.txt", b" \n\n "), ("d.txt", None)):
        with pytest.raises(Exception, match="no units in document"):
            upload.units(docs((1, name, content))).collect()
    why = "reading PDF needs pypdf" if importlib.util.find_spec("pypdf") is None else "unreadable PDF"
    with pytest.raises(Exception, match=why):
        upload.units(docs((1, "e.PDF", b"%PDF-1.4"))).collect()


def test_counts_of_imports_and_of_filled_segments(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), (" ", "b"), (None, "b")], "source string, target string")
    assert tuple(pipelines.import_counts(pairs).first()) == (4, 2)
    seg = spark.createDataFrame([(1, 1, "new", ""), (2, 1, "new", None), (3, 1, "draft", ""), (4, 2, "new", "x")], "id long, file_id long, state string, target string")
    assert [tuple(r) for r in pipelines.filled_counts(seg, spark.createDataFrame([(2,)], "id long")).collect()] == [(1, 2, 1)]


def test_late_events_are_let_go(spark, tmp_path):
    """Three files in order of arrival: the last brings one event within the lateness, one beyond it, and a repeat of each kind."""
    rows = "event_id long, segment_id long, ts timestamp, arrived_at timestamp, target string, state string"
    parts = [["(1, '2024-01-01')", "(2, '2024-01-02')"], ["(3, '2024-01-20')"], ["(4, '2024-01-19')", "(5, '2024-01-03')", "(3, '2024-01-20')"]]
    folder = tmp_path / "confirm_events.parquet"
    for n, part in enumerate(parts):
        df = spark.sql(f"select cast(e as long) event_id, 1L segment_id, cast(ts as timestamp) ts, cast(ts as timestamp) arrived_at, 'x' target, 'draft' state from values {', '.join(part)} as t(e, ts)")
        df.to(spark.createDataFrame([], rows).schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = learning.events_stream(spark, str(tmp_path), "confirm_events.parquet")
        seen = learning.run_once(learning.once(stream, "7 days").select("event_id"), str(tmp_path / "once"), "append")
        days = learning.run_once(learning.counted(stream, "7 days"), str(tmp_path / "days"), "append")
    assert sorted(r.event_id for r in seen.collect()) == [1, 2, 3, 4]
    assert {(r.day, r.arrivals) for r in days.collect()} == {("2024-01-01", 1), ("2024-01-02", 1)}


def test_services_are_optional(spark):
    pairs = spark.createDataFrame([(1, "Hello", "en"), (2, None, "en"), (3, "x", "zz")], "id long, target string, tgt_lang string")
    assert services.grammar_issues(pairs, "http://127.0.0.1:9", 0.2).count() == 0
    with pytest.raises(ImportError):
        services.machine_translations(pairs)


def test_stream_teaches_the_memory_once(spark, tmp_path):
    seg = spark.createDataFrame([(1, "cat", "", "new", "en", "ru")], "id long, source string, target string, state string, src_lang string, tgt_lang string")
    mem = str(tmp_path / "memory")
    memory.upsert_units(units(spark, ("dog", "собака"))).write.parquet(f"{mem}/version=0")
    events = spark.sql("select 1L event_id, 1L segment_id, timestamp'2024-01-01' ts, timestamp'2024-01-01' arrived_at, 'кот' target, 'approved' state union all select 1L, 1L, timestamp'2024-01-01', timestamp'2024-01-02', 'кот', 'approved'")
    events.write.parquet(str(tmp_path / "confirm_events.parquet"))
    stream = learning.events_stream(spark, str(tmp_path), "confirm_events.parquet")
    for _ in range(2):
        learning.learn(stream, seg, mem, str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.source, r.origin, r.use_count) for r in spark.read.parquet(f"{mem}/version=1").collect()}
    assert got == {("dog", "manual", 0), ("cat", "editor", 0)} and not (tmp_path / "memory" / "version=2").exists()


def test_counted_windows(spark):
    events = spark.sql("select timestamp'2024-01-01 05:00' ts, 'a' state union all select timestamp'2024-01-01 06:00', 'a' union all select timestamp'2024-01-02', null")
    got = {(r.day, r.state, r.arrivals) for r in learning.counted(events).collect()}
    assert got == {("2024-01-01", "a", 2), ("2024-01-02", "unchanged", 1)}
