import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.llm import folding
from weftwork.llm.formcopies import copy_counts, form_copies
from weftwork.llm.nearcopies import components, near_groups, near_pairs

SCHEMA = "id long, src_lang string, tgt_lang string, source string, target string, k1 string, rep string, salt int"


def units(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)


def base(c):
    return (c or "").strip().lower().replace("_", "-").split("-")[0]


def fold(x):
    return re.sub(r"[\W_]", "", (x or "").casefold())


def brute_copies(rows):
    groups = defaultdict(set)
    for i, a, b, s, t in rows:
        if i is not None and fold(s) and fold(t):
            x, y = (base(a), fold(s)), (base(b), fold(t))
            groups[min(x, y), max(x, y)].add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def brute_near(rows):
    words = lambda x: Counter(re.findall(r"[^\W_]+", (x or "").lower()))
    out = set()
    items = list({r[0]: (r[0], base(r[1]), base(r[2]), words(r[3]), words(r[4]), fold(r[3]), fold(r[4])) for r in rows if r[0] is not None}.values())
    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if a[1:3] != b[1:3] or a[5:] == b[5:] or min(a[3].total(), b[3].total()) < 8 or not min(a[4].total(), b[4].total()):
                continue
            if all((a[k] & b[k]).total() * 5 >= max(a[k].total(), b[k].total()) * 4 for k in (3, 4)):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


EDGE = [
    (1, "en", "ru", "Go, NOW to 5", "Иди"), (2, "EN_us", " ru", "go now to 5!", "иди."), (3, "ru", "en", "ИДИ", "Go-now to 5"), (4, "en", "nl", "go now to 5", "иди"),
    (5, "en", "ru", None, "иди"), (6, "en", "ru", "go", ""), (7, "en", "ru", "…", "—"), (8, "en", "ru", "…", "—"), (9, None, None, "a", "b"), (10, None, "", "A", "B"),
    (11, "de", "en", "Maß", "x"), (12, "de", "en", "MASS", "X"), (13, "de", "en", "mas", "x"), (14, "en", "ru", "w " * 20000, "y " * 20000), (15, "en", "ru", "W" * 20000, "Y" * 20000),
    (None, "en", "ru", "go now to 5", "иди"), (2, "EN_us", " ru", "go now to 5!", "иди."),
]


def test_copies_of_edge_cases(spark):
    got = [tuple(r) for r in form_copies(units(spark, EDGE)).collect()]
    assert sorted(got) == sorted(brute_copies(EDGE)) == [(1, 2), (1, 3), (9, 10), (11, 12), (14, 15)]
    counts = dict(map(tuple, copy_counts(units(spark, EDGE)).collect()))
    assert counts[1] == 3 and counts[14] == 2 and counts[5] == 1 and 2 not in counts


def test_empty_table(spark):
    none = units(spark, [])
    assert form_copies(none).count() == copy_counts(none).count() == near_pairs(none).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(n, "en", "ru", "Same text, again and again" if n % 3 else f"other {n}", "тот же") for n in range(600)]
    assert set(map(tuple, form_copies(units(spark, rows)).collect())) == brute_copies(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbBß. ,-éİ１1яЯ́", max_size=12), min_size=1, max_size=6))
def test_hashes_agree_with_the_comparison(texts):
    h1, h2, n = folding.folded_hashes(pa.array(texts))
    for i, a in enumerate(texts):
        want = "".join(map(folding.fold_char, a))
        assert n[i] == len(want)
        for j, b in enumerate(texts):
            same = want == "".join(map(folding.fold_char, b))
            assert folding.same_folded(a, b) == same == ((h1[i], h2[i]) == (h1[j], h2[j]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(25)]
    rows, n = [], 0
    for _ in range(40):
        s, t = r.choices(vocabulary, k=r.randint(6, 60)), r.choices(vocabulary, k=r.randint(1, 14))
        for _ in range(r.randint(1, 4)):
            s2, t2 = list(s), list(t)
            for x in (s2, t2):
                if r.random() < 0.7:
                    x[r.randrange(len(x))] = r.choice(vocabulary)
                if r.random() < 0.3:
                    r.shuffle(x)
                if r.random() < 0.3:
                    x.insert(0, r.choice(vocabulary))
            n += 1
            rows.append((n, r.choice(["en", "en-US"]), "ru", r.choice([" ", ", "]).join(s2), " ".join(t2)))
    rows += [(1000, "en", "ru", None, "x"), (1001, "en", "ru", "a b c d e f g h", None), (1002, "en", "ru", "a b c d e f g h", ""), (1003, "en", "ru", "a b c d e f g h", "…"), (rows[0][0], *rows[0][1:])]
    got = [tuple(x) for x in near_pairs(units(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows)


def test_reordered_words_are_near_and_copies_are_not(spark):
    s = "one two three four five six seven eight"
    rows = [(1, "en", "nl", s, "een twee"), (2, "en", "nl", " ".join(s.split()[::-1]), "een twee"), (3, "en", "nl", s.upper() + "!", "Een, twee"), (4, "en", "ru", s, "een twee")]
    assert set(map(tuple, near_pairs(units(spark, rows)).collect())) == {(1, 2), (2, 3)}


def test_very_long_near_copies(spark):
    words = [f"v{n}" for n in range(3000)]
    rows = [(1, "en", "nl", " ".join(words), "x"), (2, "en", "nl", " ".join(words[:2500]), "x"), (3, "en", "nl", " ".join(words[:2000]), "x")]
    assert set(map(tuple, near_pairs(units(spark, rows)).collect())) == {(1, 2), (2, 3)}


def test_every_unit_has_its_class_links_and_group(spark):
    """1 - 3 - 4 is a chain of near copies, 2 an exact copy of 1; 5 and 6 are exact copies only; the others are alone."""
    words = [f"w{n}" for n in range(10)]
    chain = [" ".join([f"x{k}" for k in range(n)] + words[n:]) for n in (0, 2, 4)]
    other = "one two three four five six seven eight"
    rows = [(1, "en", "nl", chain[0], "een"), (2, "en", "nl", chain[0].upper(), "een!"), (3, "en", "nl", chain[1], "een"), (4, "en", "nl", chain[2], "een")]
    rows += [(5, "en", "nl", other, "twee"), (6, "en", "nl", other + ".", "twee"), (7, "en", "nl", "short", "x"), (8, None, None, None, None), (8, None, None, None, None), (None, "en", "nl", other, "twee")]
    got = sorted((r.id, r.rep, r.links, r.group_id) for r in near_groups(units(spark, rows)).collect())
    assert got == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 2, 1), (4, 4, 1, 1), (5, 5, 0, 5), (6, 5, 0, 5), (7, 7, 0, 7), (8, 8, 0, 8)]
    assert near_groups(units(spark, [])).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(5)
    pairs = [(n, n + 1) for n in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, n) for n in range(301, 330)]
    pairs = [p for p in pairs if p[0] != p[1]]
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert sorted(map(tuple, components(spark.createDataFrame(pairs, "rep_a long, rep_b long")).collect())) == sorted(up.items())
