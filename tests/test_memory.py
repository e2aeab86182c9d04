import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.operators import fulltext, learn, lexicon, memory, suggest, volume

PARTS = {"pump": "насос", "valve": "клапан", "filter": "фильтр"}
FAULTS = {"leaks": "течёт", "rattles": "гремит", "overheats": "греется"}
CORPUS = [(f"{p} {f}", f"{q} {g}") for p, q in PARTS.items() for f, g in FAULTS.items()]
SCHEMA = "id long, src_lang string, tgt_lang string, source string, target string, origin string, use_count long, updated_at timestamp"


def units(spark, pairs=CORPUS, langs=("en", "ru")):
    return spark.createDataFrame([(n, *langs, s, t, "corpus", 0, None) for n, (s, t) in enumerate(pairs, 1)], SCHEMA)


def asked(spark, *texts, langs=("en", "ru")):
    rows = spark.createDataFrame([(*langs, t) for t in texts], "src_lang string, tgt_lang string, source string")
    return memory.queries_of(rows, "id")


def test_norm_lang_and_plain(spark):
    rows = spark.createDataFrame([(" EN_us ",), (None,), ("nl-NL",)], "c string").select(X.norm_lang(F.col("c")).alias("c")).collect()
    assert [r.c for r in rows] == ["en", "", "nl"]
    row = spark.createDataFrame([('  a <g id="1">b</g> c　',)], "c string").select(memory.plain(F.col("c")).alias("p"), X.tokens(F.col("c")).alias("t")).first()
    assert row.p == "a b c" and row.t == ["a", "b", "c"]


def test_upsert_counts_repeats_and_keeps_the_first(spark):
    rows = [(2, "en", "ru", " a  b ", "x", "tmx", 3, None), (1, "EN", "ru-RU", "a b", "x", "manual", None, None), (3, "en", "ru", " ", "x", None, 0, None), (4, "en", "ru", "a b", None, None, 0, None)]
    got = memory.upsert_units(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.id, r.source, r.origin, r.use_count) for r in got] == [(1, "a b", "manual", 4)]


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_similarity_is_word_edit_distance(spark):
    r = random.Random(3)
    rows = [(r.choices("abcdef", k=r.randint(0, 9)), r.choices("abcdefgh", k=r.randint(0, 9))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", memory.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        longest = max(len(x.a), len(x.b))
        want = 1.0 if not longest else 0.0 if not x.a or not x.b else 1 - word_distance(x.a, x.b) / longest
        assert abs(x.s - want) < 1e-12


def test_lookup_exact_and_fuzzy(spark):
    found = memory.lookup(asked(spark, "pump leaks", "Pump stops", "unknown words here"), memory.upsert_units(units(spark))).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r.plain, []).append((r.source, r.percent))
    assert by["pump leaks"][0] == ("pump leaks", 100)
    assert {s for s, _ in by["Pump stops"]} == {"pump leaks", "pump rattles", "pump overheats"} and by["Pump stops"][0][1] == 50
    assert "unknown words here" not in by


def test_prefix_search_loses_nothing(spark):
    r = random.Random(5)
    texts = sorted({" ".join(r.choices("abcdefghij", k=r.randint(1, 8))) for _ in range(120)})
    mem = memory.upsert_units(units(spark, [(t, "x") for t in texts]))
    ask = asked(spark, *[" ".join(r.choices("abcdefghijk", k=r.randint(1, 8))) for _ in range(40)])
    found = memory.lookup(ask, mem, 0.5, 1000).collect()
    got = {(x.plain, x.source) for x in found}
    want = {(q, t) for q in {x.plain for x in ask.collect()} for t in texts if 1 - word_distance(q.split(), t.split()) / max(len(q.split()), len(t.split())) >= 0.5}
    assert got == want


def test_search_does_not_grow_with_texts_of_one_phrase(spark):
    pairs = [(f"store a{n} apart from b{n % 150} under number {n % 7}", str(n)) for n in range(300)]
    texts = [f"store c{n} apart from b{n} under number x{n}" for n in range(100)]
    mem = memory.upsert_units(units(spark, pairs))
    ask = asked(spark, *texts)
    toks = lambda df, c: df.withColumn("toks", X.tokens_of_plain(F.col(c)))
    assert memory.prefix_candidates(memory.keyed(ask), toks(mem, "source"), 0.5, 3).count() <= 100 * (3 + 2)
    got = {}
    for r in memory.lookup(ask, mem, 0.5, 3).collect():
        got.setdefault(r.plain, {})[r["rank"]] = r.id
    for q in texts:
        scored = sorted((-round(1 - word_distance(q.split(), t.split()) / 8, 4), n) for n, (t, _) in enumerate(pairs, 1))
        assert got[q] == {k: n for k, (_, n) in enumerate(scored[:3], 1)}


def test_bm25_mode_and_ties_go_by_id(spark):
    pairs = [("alpha beta", "1"), ("alpha gamma", "2"), ("alpha delta", "3")]
    found = memory.lookup(asked(spark, "alpha omega"), memory.upsert_units(units(spark, pairs)), mode="bm25").orderBy("rank").collect()
    assert [r.id for r in found] == [1, 2, 3] and {r.percent for r in found} == {50}


def naive_bm25(texts, query, limit):
    """[(id, score)] best first, of texts of one language pair."""
    docs = [t.split() for t in texts]
    longest = sorted(set(query.split()), key=lambda w: (-len(w), w))[:12]
    mean, out = sum(map(len, docs)) / len(docs), {}
    for w in longest:
        df = sum(w in d for d in docs)
        idf = math.log((len(docs) - df + 0.5) / (df + 0.5))
        for n, d in enumerate(docs, 1):
            if tf := d.count(w):
                out[n] = out.get(n, 0) + (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return sorted(((n, -round(v, 9)) for n, v in out.items()), key=lambda x: (x[1], x[0]))[:limit]


def test_full_text_search_in_blocks_and_parts(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: r.choice(["store", "apart", "number"]) if r.random() < 0.6 else f"w{r.randint(0, 60)}"
    texts = list(dict.fromkeys(" ".join(word() for _ in range(r.randint(1, 9))) for _ in range(400)))
    mem = memory.upsert_units(units(spark, [(t, "x") for t in texts]))
    asks = list(dict.fromkeys([*(" ".join(word() for _ in range(r.randint(1, 16))) for _ in range(60)), *texts[:5], "unheard of"]))
    for block, part in ((1 << 18, 1 << 16), (37, 13)):
        for name, value in {"AT_ONCE": 7, "BLOCK": block, "PART": part, "PART_LEAST": 20, "COMMON_DF": 9}.items():
            monkeypatch.setattr(memory, name, value)
        got = {}
        for x in memory.bm25_candidates(memory.keyed(asked(spark, *asks)), mem).orderBy("plain", "place").collect():
            got.setdefault(x.plain, []).append((x.id, x.bm25))
        want = {q: naive_bm25(texts, q, 80) for q in asks}
        assert {q: [n for n, _ in v] for q, v in got.items()} == {q: [n for n, _ in v] for q, v in want.items() if v}
        assert all(abs(a - b) < 2e-9 for q in got for (_, a), (_, b) in zip(got[q], want[q]))
        found = {}
        for x in memory.lookup(asked(spark, *asks), mem, 0.5, 3, "bm25").orderBy("plain", "rank").collect():
            found.setdefault(x.plain, []).append((x.id, x.score))
        for q in asks:
            a = q.split()
            scored = [(-round(1 - word_distance(a, texts[n - 1].split()) / max(len(a), len(texts[n - 1].split())), 4), place, n) for place, (n, _) in enumerate(want[q])]
            assert found.get(q, []) == [(n, -s) for s, _, n in sorted(x for x in scored if x[0] <= -0.5)[:3]]


def test_full_text_search_scores_a_shape_once():
    r = np.random.default_rng(3)
    n = 3000
    terms = np.column_stack([np.tile([1, 2, 3], (n, 1)), r.permutation(n) + 100]).ravel()
    known, df = np.array([1, 2, 3, *range(100, 100 + n)]), np.array([n] * 3 + [1] * n)
    block = fulltext.Block(terms, np.full(n, 4), known, df, 4 * n, 4.0, 50)
    assert len(block.members) == 1 and sum(len(docs) for docs, _ in block.shapes) == 3
    size, docs, _ = block.best(np.column_stack([np.tile([0, 1, 2], (n, 1)), np.arange(n) + 3]).ravel(), np.full(n, 4), 2)
    assert (size == 2).all() and (terms.reshape(n, 4)[docs[::2], 3] == np.arange(n) + 100).all() and set(docs[1::2]) <= {0, 1}


def test_word_distances_of_many_pairs():
    r = random.Random(4)
    texts = [[r.randint(0, 3) for _ in range(n)] for n in [*range(40), 300, 700] * 2]
    flat, sizes = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    at, (a, b) = fulltext.starts_of(sizes)[:-1], np.array([(i, (i * 7 + 3) % len(texts)) for i in range(len(texts))]).T
    got = fulltext.distances(flat, at[a], sizes[a], flat, at[b], sizes[b])
    assert got.tolist() == [word_distance(texts[i], texts[j]) for i, j in zip(a, b)]


def test_concordance_folds_ascii_only(spark):
    mem = units(spark, [("Red CAT", "Кот"), ("blue dog", "кот 100%")])
    ids = lambda q: [r.id for r in memory.concordance(mem, q, "en", "ru").collect()]
    assert ids("cat") == [1] and ids("кот") == [2] and ids("100%") == [2] and ids("b_ue") == [2]


def test_lexicon_learns_translations(spark):
    rows = lexicon.train(memory.upsert_units(units(spark))).collect()
    best = {}
    for r in rows:
        best[r.src_word] = max(best.get(r.src_word, (0, "")), (r.prob, r.tgt_word))
    assert {w: best[w][1] for w in [*PARTS, *FAULTS]} == PARTS | FAULTS


def naive_probabilities(pairs, rounds=6):
    prob = {(s, t): 1.0 for a, b in pairs for s in a for t in b}
    for k in range(rounds + 1):
        whole = {}
        for (s, _), p in prob.items():
            whole[s] = whole.get(s, 0) + p
        prob = {x: p / whole[x[0]] for x, p in prob.items()}
        if k == rounds:
            return prob
        new = dict.fromkeys(prob, 0.0)
        for a, b in pairs:
            for t in b:
                z = sum(prob[s, t] for s in a)
                for s in a:
                    new[s, t] += prob[s, t] / z
        prob = new


def test_lexicon_is_the_same_in_parts_and_with_heavy_words(spark, monkeypatch):
    r = random.Random(8)
    pairs = [([r.choice("abcdefgh") * 2 for _ in range(r.randint(1, 7))], ["de"] * r.randint(0, 2) + [r.choice("pqrstuvw") * 2 for _ in range(r.randint(1, 6))]) for _ in range(150)]
    pairs = list({(" ".join(a), " ".join(b)): (a, b) for a, b in pairs}.values())
    mem = memory.upsert_units(units(spark, [(" ".join(a), " ".join(b)) for a, b in pairs]))
    want = naive_probabilities(pairs)
    for part, heavy in ((1 << 22, 1 << 20), (700, 1 << 20), (700, 300)):
        for name, value in {"PART": part, "PART_LEAST": 100, "HEAVY": heavy}.items():
            monkeypatch.setattr(lexicon, name, value)
        got = {(x.src_word, x.tgt_word): x.prob for x in lexicon.train(mem).collect()}
        assert got and all(abs(p - want[k]) < 6e-5 for k, p in got.items())
        assert {k for k, p in want.items() if p >= 0.1501} <= {*got}


def test_lexicon_round_needs_only_sums_of_source_words():
    texts = np.array([1, 2, 3] * 500)
    part = lexicon._Part(texts, np.full(500, 3), np.arange(1000) % 7, np.full(500, 2), np.zeros(0, np.int64))
    assert len(part.keys()) == 3 and len(part.cell) == 3000 and len(part.cell_t) == 21


def test_repair_gloss_and_chain(spark):
    words = [("pump", "насос", 0.9), ("valve", "клапан", 0.8), ("rear", "задний", 0.5), ("front", "передний", 0.7), ("front", "перед", 0.2), ("lamp", "лампа", 0.1)]
    lex = spark.createDataFrame([("en", "ru", *w) for w in words], "src_lang string, tgt_lang string, src_word string, tgt_word string, prob double")
    mem = memory.upsert_units(units(spark, [("check the front pump before start", "Проверьте передний Насос, насос перед пуском")]))
    texts = ["check the front valve before start", "check the front pump before start", "check the front fan before start", "check the rear valve before start", "check the front lamp before start", "Rear pump!", "zzz"]
    got = {r.plain: (r.text, r.provider, r.percent) for r in suggest.suggestions(asked(spark, *texts), mem, lex).collect()}
    assert got[texts[1]] == ("Проверьте передний Насос, насос перед пуском", suggest.EXACT, 100)
    assert got[texts[0]] == ("Проверьте передний клапан, насос перед пуском", suggest.REPAIRED, 88)
    assert got[texts[3]] == ("Проверьте задний клапан, насос перед пуском", suggest.REPAIRED, 72)
    assert got[texts[4]] == ("Проверьте передний лампа, насос перед пуском", suggest.REPAIRED, 88)
    assert got[texts[2]] == ("Проверьте передний Насос, насос перед пуском", suggest.FUZZY, 83)
    assert got["Rear pump!"] == ("Задний насос!", suggest.GLOSS, 30) and "zzz" not in got


def test_bands_repetitions_and_half_even_percent(spark):
    seg = "id long, file_id long, seq int, source string, target string, state string, project_id long, src_lang string, tgt_lang string"
    texts = ["pump leaks", "pump leaks", "Pump  leaks!", "pump stops", "all of it is new", None, ""]
    rows = [(n, 1, n, t, "", "new", 7, "en", "ru") for n, t in enumerate(texts)]
    got = {r.band: (r.words, r.segments) for r in volume.volume_bands(spark.createDataFrame(rows, seg), memory.upsert_units(units(spark))).collect()}
    assert got == {"exact": (2, 1), "repetition": (4, 2), "fuzzy_50_74": (2, 1), "new": (5, 1)}
    row = spark.sql("select 0.625D a, 0.745D b, 0.99749D c").select(*[memory.percent(F.col(c)).alias(c) for c in "abc"]).first()
    assert (row.a, row.b, row.c) == (62, 74, 100)


def test_confirmations_settle_and_teach(spark):
    seg = spark.createDataFrame([(1, "a <b>cat</b>", "", "new", "en", "ru"), (2, "dog", "x", "draft", "en", "ru")], "id long, source string, target string, state string, src_lang string, tgt_lang string")
    ev = spark.sql("""select * from values (1L, 1L, timestamp'2024-01-01', timestamp'2024-01-01', 'кот', 'draft'), (2L, 1L, timestamp'2024-01-02', timestamp'2024-01-02', null, 'approved'),
      (2L, 1L, timestamp'2024-01-02', timestamp'2024-01-05', null, 'approved'), (3L, 1L, timestamp'2024-01-03', timestamp'2024-01-03', null, null), (4L, 2L, timestamp'2024-01-03', timestamp'2024-01-03', ' ', 'translated')
      as t(event_id, segment_id, ts, arrived_at, target, state)""")
    done = {r.segment_id: (r.target, r.state) for r in learn.settled(ev, seg).collect()}
    assert done == {1: ("кот", "approved"), 2: (" ", "translated")}
    taught = learn.taught(ev, seg)
    assert [(r.source, r.target, r.confirmations) for r in taught.collect()] == [("a cat", "кот", 2)]
    both = {(r.source, r.origin, r.use_count) for r in learn.merged(memory.upsert_units(units(spark, [("a cat", "кот")])), taught).collect()}
    assert both == {("a cat", "corpus", 2)}


def test_empty_tables(spark):
    none = units(spark, [])
    assert memory.upsert_units(none).count() == 0
    assert memory.lookup(asked(spark, "a b"), memory.upsert_units(none)).count() == 0
    assert lexicon.train(memory.upsert_units(none)).count() == 0
