"""SQL for DuckDB that gives what the queries give, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from weftwork.functions.text import ABBREVIATIONS, SPACE
from weftwork.operators.memory import _BARE, _MARKED

WORD = r"[\p{L}\p{N}_]+"
DONE = "('translated', 'approved')"


def lang(c: str) -> str:
    return f"split_part(replace(lower(trim(coalesce({c}, ''))), '_', '-'), '-', 1)"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def untagged(c: str) -> str:
    return f"regexp_replace({c}, '<[^<>]+>', ' ', 'g')"


def plain(c: str) -> str:
    return collapse(untagged(c))


def toks(c: str) -> str:
    return f"regexp_extract_all(lower({untagged(c)}), '{WORD}')"


MEMORY = f"""mem AS (
  SELECT src_lang, tgt_lang, source, target, min(id) AS id, min(struct_pack(i := id, o := origin)).o AS origin,
         (sum(uses) + count(*) - 1)::BIGINT AS use_count, max(updated_at) AS updated_at
  FROM (SELECT id, {lang("src_lang")} AS src_lang, {lang("tgt_lang")} AS tgt_lang, {collapse("source")} AS source, {collapse("target")} AS target,
               origin, coalesce(use_count, 0) AS uses, updated_at FROM tm_units)
  WHERE source <> '' AND target <> '' GROUP BY ALL)"""
MEMORY = MEMORY.replace("GROUP BY ALL", "GROUP BY src_lang, tgt_lang, source, target")
LOCATED = f"""loc AS (
  SELECT s.*, f.project_id, {lang("p.src_lang")} AS src_lang, {lang("p.tgt_lang")} AS tgt_lang
  FROM segments s JOIN files f ON f.id = s.file_id JOIN projects p ON p.id = f.project_id)"""
ASKED = f"""q AS (
  SELECT *, {toks("plain")} AS qt FROM (SELECT DISTINCT src_lang, tgt_lang, {plain("source")} AS plain FROM loc) WHERE plain <> '')"""
_SYMBOLS = "list_aggregate(list_transform({0}, lambda w: chr((coalesce(list_position(v, w), 0) + 1)::INT)), 'string_agg', '')"
#: Every pair of a language pair that may reach a half, with its similarity; word edit distance as in the operator.
SCORED = f"""m AS (SELECT *, {toks("source")} AS mt FROM mem),
pairs AS (
  SELECT q.src_lang, q.tgt_lang, q.plain, qt, m.id, m.use_count, m.target, m.source, mt, list_distinct(qt) AS v, (q.plain = m.source)::INT AS exact
  FROM q JOIN m ON q.src_lang = m.src_lang AND q.tgt_lang = m.tgt_lang
  WHERE q.plain = m.source OR (len(qt) > 0 AND len(mt) > 0 AND least(len(qt), len(mt)) * 2 >= greatest(len(qt), len(mt))
        AND len(list_intersect(qt, mt)) > 0)),
scored AS (
  SELECT *, CASE WHEN exact = 1 THEN 1.0::DOUBLE
       ELSE 1 - levenshtein({_SYMBOLS.format("qt")}, {_SYMBOLS.format("mt")}) / greatest(len(qt), len(mt))::DOUBLE END AS raw FROM pairs),
hits AS (SELECT *, round_even(raw, 4) AS score, round_even(round_even(raw, 4) * 100, 0)::INT AS percent FROM scored WHERE raw >= 0.5)"""
RANKED = """top AS (
  SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, plain ORDER BY score DESC, use_count DESC, exact DESC, place, id)::INT AS rank FROM {0})"""


def _bm25() -> str:
    terms = lambda c: f"regexp_extract_all(translate(lower({c}), '{_MARKED}', '{_BARE}'), '[\\p{{L}}\\p{{N}}]+')"
    return f"""docs AS (SELECT id, src_lang, tgt_lang, {terms("source")} AS ts FROM mem),
size AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM docs),
post AS (SELECT id, src_lang, tgt_lang, len(ts) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qterm AS (SELECT src_lang, tgt_lang, plain, term FROM (
   SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, plain ORDER BY length(term) DESC, term) AS k
   FROM (SELECT DISTINCT src_lang, tgt_lang, plain, unnest({terms("plain")}) AS term FROM q)) WHERE k <= 12),
bm AS (SELECT t.src_lang, t.tgt_lang, t.plain, p.id,
   round(-sum(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
        * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25
   FROM qterm t JOIN dfs USING (term) JOIN post p ON p.term = t.term AND p.src_lang = t.src_lang AND p.tgt_lang = t.tgt_lang, size GROUP BY ALL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, plain ORDER BY bm25, id)::INT AS place FROM bm) WHERE place <= 80)"""


_BM_HITS = """bmhits AS (
  SELECT h.*, coalesce(c.place, 0) AS place FROM hits h LEFT JOIN cand c USING (src_lang, tgt_lang, plain, id) WHERE exact = 1 OR c.id IS NOT NULL)"""
_ALL_HITS = "allhits AS (SELECT *, 0 AS place FROM hits)"
_FIRST = f"""rows AS (
  SELECT *, len(ts) AS words, array_to_string(ts, ' ') AS k FROM (SELECT *, {toks("source")} AS ts FROM loc)),
rep AS (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY file_id, seq, id) > 1 AS again FROM rows)"""


def _bands(hits: str, top: str) -> str:
    return f"""WITH {MEMORY}, {LOCATED}, {_FIRST},
fresh AS (SELECT *, {plain("source")} AS plain FROM rep WHERE NOT again AND words > 0),
q AS (SELECT *, {toks("plain")} AS qt FROM (SELECT DISTINCT src_lang, tgt_lang, plain FROM fresh)),
{SCORED}, {hits}, {RANKED.format(top)},
best AS (SELECT src_lang, tgt_lang, plain, percent FROM top WHERE rank = 1),
all_rows AS (
  SELECT project_id, CASE WHEN percent >= 100 THEN 'exact' WHEN percent >= 75 THEN 'fuzzy_75_99' WHEN percent >= 50 THEN 'fuzzy_50_74' ELSE 'new' END AS band, words
  FROM fresh LEFT JOIN best USING (src_lang, tgt_lang, plain)
  UNION ALL SELECT project_id, 'repetition', words FROM rep WHERE again)
SELECT project_id, band, sum(words)::BIGINT AS words, count(*) AS segments FROM all_rows GROUP BY 1, 2"""


def _lookup(hits: str, top: str) -> str:
    return f"WITH {MEMORY}, {LOCATED}, {ASKED}, {SCORED}, {hits}, {RANKED.format(top)} SELECT src_lang, tgt_lang, plain, rank, id, percent FROM top WHERE rank <= 5"


def _concordance(query: str, src: str, tgt: str) -> str:
    fold = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH {MEMORY} SELECT id, source, target, use_count FROM mem WHERE src_lang = '{src}' AND tgt_lang = '{tgt}'
    AND ({fold("source")} LIKE {fold(f"'%{query}%'")} OR {fold("target")} LIKE {fold(f"'%{query}%'")})
    ORDER BY use_count DESC, updated_at DESC NULLS LAST, id LIMIT 30"""


def _sentences() -> str:
    abbreviation = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
    return rf"""WITH par AS (
  SELECT doc_id, p_no, p FROM (SELECT doc_id, generate_subscripts(ps, 1) AS p_no, {collapse("unnest(ps)")} AS p
    FROM (SELECT doc_id, regexp_split_to_array(text, '\n{SPACE}*\n|\r\n{SPACE}*\r\n') AS ps FROM documents WHERE text IS NOT NULL)) WHERE p <> ''),
w AS (SELECT doc_id, p_no, generate_subscripts(ws, 1) AS w_no, unnest(ws) AS w FROM (SELECT doc_id, p_no, string_split(p, ' ') AS ws FROM par)),
x AS (SELECT *, lag(w) OVER o AS before FROM w WINDOW o AS (PARTITION BY doc_id, p_no ORDER BY w_no)),
b AS (SELECT *, CASE WHEN regexp_matches(before, '[.!?…]$') AND NOT regexp_matches(before, '(^|[^\p{{L}}\p{{N}}_.])(?i:{abbreviation}|\p{{L}})[.!?…]+$')
        AND NOT regexp_matches(w, '^\p{{Ll}}') THEN 1 ELSE 0 END AS cut FROM x),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, p_no ORDER BY w_no) AS s_no FROM b),
s AS (SELECT doc_id, p_no, s_no, string_agg(w, ' ' ORDER BY w_no) AS source FROM g GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p_no, s_no)::INT AS seq, source FROM s"""


def _quality() -> dict[str, str]:
    rows = f"""WITH {LOCATED}, pair AS (
  SELECT id, coalesce(source, '') AS s, coalesce(target, '') AS t, {lang("src_lang")} AS src_lang, {lang("tgt_lang")} AS tgt_lang FROM tm_units
  UNION ALL SELECT -id, coalesce(source, ''), coalesce(target, ''), src_lang, tgt_lang FROM loc),
row AS (SELECT *, {toks("s")} AS sw, {toks("t")} AS tw, regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g') AS ss,
  regexp_replace(t, '^{SPACE}+|{SPACE}+$', '', 'g') AS ts FROM pair),
r AS (SELECT * FROM row WHERE ts <> '')"""
    numbers = lambda c: rf"list_sort(list_transform(regexp_extract_all({c}, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*'), lambda x: replace(x, ',', '.')))"
    tags = lambda c: rf"list_sort(regexp_extract_all({c}, '<(/?[\p{{L}}\p{{N}}_:.-]+)[^<>]*>', 1))"
    marked = lambda c: f"(rtrim_{c} = '' OR instr('.!?:;…', right(rtrim_{c}, 1)) > 0)"
    ratio = "(length(t) / greatest(1, length(s))::DOUBLE)"
    capital = r"'^\p{Lu}'"
    repeat = "len(list_filter(range(2, len(tw) + 1), lambda i: tw[i] = tw[i - 1] AND length(tw[i]) > 1)) > 0"
    rules = {
        "untranslated": ("warning", "ss = ts AND src_lang <> tgt_lang AND len(sw) > 2"),
        "tags": ("error", f"{tags('s')} <> {tags('t')}"),
        "numbers": ("error", f"{numbers('s')} <> {numbers('t')}"),
        "whitespace": ("warning", "ts <> t"),
        "double_space": ("warning", "instr(t, '  ') > 0"),
        "punct_end": ("warning", f"{marked('s')} <> {marked('t')}".replace("rtrim_s", f"regexp_replace(s, '{SPACE}+$', '')").replace("rtrim_t", f"regexp_replace(t, '{SPACE}+$', '')")),
        "length": ("warning", f"len(sw) > 0 AND len(tw) > 0 AND ({ratio} > 2.6 OR {ratio} < 0.35)"),
        "repeated_word": ("warning", repeat),
        "capitalization": ("warning", rf"regexp_matches(s, '^\p{{L}}') AND regexp_matches(t, '^\p{{L}}') AND regexp_matches(s, {capital}) <> regexp_matches(t, {capital})"),
        "ru_quotes": ("warning", """tgt_lang = 'ru' AND regexp_matches(t, '"[^"]+"')"""),
        "ru_dash": ("warning", f"tgt_lang = 'ru' AND regexp_matches(t, '{SPACE}-{SPACE}')"),
        "ru_mixed_script": ("error", "tgt_lang = 'ru' AND regexp_matches(t, '[а-яА-ЯёЁ][a-zA-Z]|[a-zA-Z][а-яА-ЯёЁ]')"),
        "nl_compound": ("warning", rf"tgt_lang = 'nl' AND regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])komma{SPACE}+splitsing([^\p{{L}}\p{{N}}_]|$)')"),
        "nl_style": ("warning", rf"tgt_lang = 'nl' AND regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])u{SPACE}+heeft([^\p{{L}}\p{{N}}_]|$)')"),
    }
    out = {f"qa_{code}": f"{rows} SELECT id, '{severity}' AS severity FROM r WHERE {cond}" for code, (severity, cond) in rules.items()}
    out["qa_empty"] = f"{rows} SELECT id, 'error' AS severity FROM row WHERE ts = ''"
    cases = [f"SELECT id, {n} AS place, '{code}' AS code, '{severity}' AS severity FROM r WHERE {cond}" for n, (code, (severity, cond)) in enumerate(rules.items(), 1)]
    cases.insert(0, "SELECT id, 0 AS place, 'empty' AS code, 'error' AS severity FROM row WHERE ts = ''")
    report = ", issue AS (" + " UNION ALL ".join(cases) + """)
SELECT #ID AS id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, string_agg(code, ',' ORDER BY place) AS codes
FROM issue WHERE #SIDE GROUP BY id"""
    out["qa_report_units"] = rows + report.replace("#ID", "id").replace("#SIDE", "id > 0")
    dutch = rows.replace("regexp_replace(t, '^", "regexp_replace(t, '^").replace("row AS (SELECT *,", r"old AS (SELECT * FROM pair), changed AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '(^| )de ', '\1u heeft ', 'g'), '(^| )het ', '\1Komma  Splitsing ', 'g') AS t) FROM old), row AS (SELECT *,").replace("'g') AS ts FROM pair)", "'g') AS ts FROM changed)")
    for code in ("nl_compound", "nl_style"):
        out[f"qa_{code}"] = f"{dutch} SELECT id, '{rules[code][0]}' AS severity FROM r WHERE {rules[code][1]}"
    words = lambda c: f"' ' || array_to_string(regexp_extract_all(lower({c}), '{WORD}'), ' ') || ' '"
    out["qa_glossary"] = f"""WITH {LOCATED}, r AS (SELECT id, src_lang, tgt_lang, lower(coalesce(source, '')) AS s, lower(coalesce(target, '')) AS t, {words("coalesce(source, '')")} AS sw FROM loc),
g AS (SELECT DISTINCT src_lang, tgt_lang, src_term, tgt_term, lower(src_term) AS ls, lower(tgt_term) AS lt, {words("src_term")} AS gw FROM glossary)
SELECT DISTINCT r.id, src_term, tgt_term FROM r JOIN g USING (src_lang, tgt_lang)
WHERE regexp_replace(t, '{SPACE}', '', 'g') <> '' AND contains(s, ls) AND contains(sw, gw) AND NOT contains(t, lt)"""
    terms = out["qa_glossary"].removeprefix(f"WITH {LOCATED}, ").replace("r AS (", "gr AS (", 1).replace("FROM r JOIN g", "FROM gr AS r JOIN g").replace("SELECT DISTINCT r.id", ", gi AS (SELECT DISTINCT r.id") + ")"
    with_terms = report.replace(", issue AS (", f", {terms}, issue AS (SELECT -id AS id, {len(rules) + 1} AS place, 'glossary' AS code, 'warning' AS severity FROM gi UNION ALL ")
    out["qa_report"] = rows + with_terms.replace("#ID", "-id").replace("#SIDE", "id < 0")
    out["qa_omission"] = f"""WITH {LOCATED}, r AS (SELECT id, src_lang, tgt_lang, {toks("source")} AS sw, {toks("target")} AS tw FROM loc
  WHERE regexp_replace(target, '{SPACE}', '', 'g') <> ''),
w AS (SELECT id, src_lang, tgt_lang, tw, src_word, min(place) AS place FROM (SELECT *, generate_subscripts(sw, 1) AS place, unnest(sw) AS src_word FROM r) GROUP BY ALL),
k AS (SELECT src_lang, tgt_lang, src_word, list(tgt_word) AS trans FROM lexicon WHERE prob >= 0.5 GROUP BY ALL),
l AS (SELECT id, src_word, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM w JOIN k USING (src_lang, tgt_lang, src_word) WHERE NOT list_has_any(trans, tw))
SELECT id, string_agg(src_word, ', ' ORDER BY n) AS words FROM l WHERE n <= 3 GROUP BY id"""
    return out


def _ibm1(rounds: int = 6) -> str:
    parts = [
        MEMORY,
        f"p AS (SELECT id, src_lang, tgt_lang, s, t FROM (SELECT *, {toks('source')} AS s, {toks('target')} AS t FROM mem) WHERE len(s) BETWEEN 1 AND 79 AND len(t) BETWEEN 1 AND 79)",
        "a AS (SELECT id, src_lang, tgt_lang, sw, count(*) AS ns FROM (SELECT id, src_lang, tgt_lang, unnest(s) AS sw FROM p) GROUP BY ALL)",
        "b AS (SELECT id, tw, count(*) AS nt FROM (SELECT id, unnest(t) AS tw FROM p) GROUP BY ALL)",
        "o AS MATERIALIZED (SELECT id, src_lang, tgt_lang, sw, tw, ns, nt FROM a JOIN b USING (id))",
        "t0 AS MATERIALIZED (SELECT *, 1.0 / count(*) OVER (PARTITION BY src_lang, tgt_lang, sw) AS pr FROM (SELECT DISTINCT src_lang, tgt_lang, sw, tw FROM o))",
    ]
    for k in range(rounds):
        parts.append(f"d{k} AS (SELECT o.src_lang, o.tgt_lang, o.sw, o.tw, nt * pr * ns / sum(pr * ns) OVER (PARTITION BY id, o.tw) AS c FROM o JOIN t{k} t ON o.src_lang = t.src_lang AND o.tgt_lang = t.tgt_lang AND o.sw = t.sw AND o.tw = t.tw)")
        parts.append(f"t{k + 1} AS MATERIALIZED (SELECT src_lang, tgt_lang, sw, tw, c / sum(c) OVER (PARTITION BY src_lang, tgt_lang, sw) AS pr FROM (SELECT src_lang, tgt_lang, sw, tw, sum(c) AS c FROM d{k} GROUP BY ALL))")
    return f"""WITH {", ".join(parts)}, x AS (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, sw ORDER BY round(pr, 9) DESC, tw) AS k FROM t{rounds})
SELECT src_lang, tgt_lang, sw AS src_word, tw AS tgt_word, round(pr, 4) AS prob FROM x WHERE k <= 4 AND round(pr, 9) >= 0.15 AND length(sw) > 1 AND length(tw) > 1"""


_LEARN = f"""ev AS (SELECT DISTINCT ON (event_id) * FROM confirm_events ORDER BY event_id, arrived_at),
e AS (SELECT event_id, ev.segment_id, ts, coalesce(last_value(ev.target IGNORE NULLS) OVER o, coalesce(loc.target, '')) AS target,
  coalesce(last_value(ev.state IGNORE NULLS) OVER o, loc.state) AS state, loc.source, loc.src_lang, loc.tgt_lang
  FROM ev JOIN loc ON loc.id = ev.segment_id WINDOW o AS (PARTITION BY ev.segment_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
taught AS (SELECT src_lang, tgt_lang, source, target, count(*) AS confirmations FROM
  (SELECT src_lang, tgt_lang, {plain("source")} AS source, {plain("target")} AS target FROM e WHERE state IN {DONE} AND regexp_replace(target, '{SPACE}', '', 'g') <> '')
  WHERE source <> '' AND target <> '' GROUP BY ALL)"""


LEXICON = f"""lx AS (SELECT src_lang, tgt_lang, src_word, tgt_word, prob FROM lexicon
  UNION SELECT src_lang, tgt_lang, w, w, 1.0 FROM (SELECT src_lang, tgt_lang, unnest(list_intersect({toks("source")}, {toks("target")})) AS w FROM mem)),
lxk AS (SELECT src_lang, tgt_lang, src_word, list(tgt_word ORDER BY prob DESC, tgt_word) AS ts, list(tgt_word ORDER BY prob DESC, tgt_word) FILTER (prob >= 0.25) AS sure FROM lx GROUP BY ALL)"""


def _repair(best: int = 1) -> str:
    """Steps old word by old word: rp1 and rp2 have the text after the first and the second exchange."""
    hit = lambda c, sure: f"list_filter(coalesce({sure}, []), lambda t: list_contains({toks(c)}, t))[1]"
    put = lambda c, h, p: rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])(?i:' || {h} || ')($|[^\p{{L}}\p{{N}}_])', '\1' || {p} || '\2')"
    return f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, plain ORDER BY score DESC, use_count DESC, exact DESC, id) AS rank FROM hits WHERE raw >= 0.6) WHERE rank <= {best}),
ex AS (SELECT src_lang, tgt_lang, plain, id, target, list_filter(mt, lambda w: NOT list_contains(qt, w)) AS gone, list_filter(qt, lambda w: NOT list_contains(mt, w)) AS come FROM best WHERE percent < 100),
rp1 AS (SELECT ex.*, {put("target", hit("target", "o.sure"), "n.ts[1]")} AS one FROM ex JOIN lxk o ON o.src_lang = ex.src_lang AND o.tgt_lang = ex.tgt_lang AND o.src_word = gone[1]
  JOIN lxk n ON n.src_lang = ex.src_lang AND n.tgt_lang = ex.tgt_lang AND n.src_word = come[1] WHERE len(gone) BETWEEN 1 AND 2 AND len(gone) = len(come) AND {hit("target", "o.sure")} IS NOT NULL),
rp2 AS (SELECT rp1.*, CASE WHEN len(gone) = 1 THEN one ELSE {put("one", hit("one", "o.sure"), "n.ts[1]")} END AS two FROM rp1
  LEFT JOIN lxk o ON o.src_lang = rp1.src_lang AND o.tgt_lang = rp1.tgt_lang AND o.src_word = gone[2] LEFT JOIN lxk n ON n.src_lang = rp1.src_lang AND n.tgt_lang = rp1.tgt_lang AND n.src_word = come[2]),
fix AS (SELECT src_lang, tgt_lang, plain, id, two AS repaired FROM rp2 WHERE two IS NOT NULL AND two <> target)"""


def _suggest() -> str:
    return rf"""gp AS (SELECT src_lang, tgt_lang, plain, generate_subscripts(ps, 1) AS place, unnest(ps) AS piece FROM (SELECT *, regexp_extract_all(plain, '{WORD}|[^\p{{L}}\p{{N}}_]+') AS ps FROM q)),
gy AS (SELECT gp.*, lxk.ts[1] AS tw FROM gp LEFT JOIN lxk ON lxk.src_lang = gp.src_lang AND lxk.tgt_lang = gp.tgt_lang AND lxk.src_word = lower(piece)),
gl AS (SELECT src_lang, tgt_lang, plain, string_agg(CASE WHEN tw IS NULL THEN piece WHEN regexp_matches(piece, '^\p{{Lu}}') THEN upper(tw[1:1]) || tw[2:] ELSE tw END, '' ORDER BY place) AS gloss FROM gy GROUP BY ALL HAVING count(tw) > 0),
sug AS (SELECT * FROM (SELECT src_lang, tgt_lang, plain,
    CASE WHEN percent >= 100 THEN target WHEN repaired IS NOT NULL THEN repaired WHEN percent IS NOT NULL THEN target ELSE gloss END AS text,
    CASE WHEN percent >= 100 THEN 'TM (exact)' WHEN repaired IS NOT NULL THEN 'TM + lexicon repair' WHEN percent IS NOT NULL THEN 'TM (fuzzy)' ELSE 'Lexicon gloss (rough draft)' END AS provider,
    CASE WHEN percent >= 100 THEN 100 WHEN repaired IS NOT NULL THEN least(99, percent + 5) WHEN percent IS NOT NULL THEN percent ELSE 30 END::INT AS percent
  FROM q LEFT JOIN (SELECT src_lang, tgt_lang, plain, target, percent FROM best) USING (src_lang, tgt_lang, plain)
    LEFT JOIN (SELECT src_lang, tgt_lang, plain, repaired FROM fix) USING (src_lang, tgt_lang, plain) LEFT JOIN gl USING (src_lang, tgt_lang, plain)) WHERE text IS NOT NULL)"""


def _chain() -> dict[str, str]:
    start = f"WITH {MEMORY}, {LOCATED}, {ASKED}, {SCORED}, {LEXICON}, {_repair()}"
    whole = f"{start}, {_suggest()}"
    filled = f"""fill AS (SELECT loc.id, file_id, text FROM loc JOIN sug ON sug.src_lang = loc.src_lang AND sug.tgt_lang = loc.tgt_lang AND sug.plain = {plain("source")}
  WHERE state = 'new' AND coalesce(target, '') = '' AND percent >= 50)"""
    return {
        "repair": f"WITH {MEMORY}, q AS (SELECT *, {toks('plain')} AS qt FROM (SELECT DISTINCT src_lang, tgt_lang, {plain('source')} AS plain FROM mem) WHERE plain <> ''), {SCORED}, {LEXICON}, {_repair(3)} SELECT * FROM fix",
        "suggest": f"{whole} SELECT * FROM sug",
        "pretranslate": f"{whole}, {filled} SELECT id, text AS target, 'draft' AS state FROM fill",
        "pretranslate_counts": f"""{whole}, {filled} SELECT loc.file_id, count(*) AS open, count(fill.id) AS filled FROM loc LEFT JOIN fill ON fill.id = loc.id
          WHERE state = 'new' AND coalesce(target, '') = '' GROUP BY 1""",
        "panel": f"""{whole}, r4 AS (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, plain ORDER BY score DESC, use_count DESC, exact DESC, id) AS k FROM hits),
          four AS (SELECT src_lang, tgt_lang, plain, count(*)::INT AS n, min(id) FILTER (k = 1) AS tm_id, min(percent) FILTER (k = 1) AS tm_percent FROM r4 WHERE k <= 4 GROUP BY ALL),
          tw AS (SELECT DISTINCT id, src_lang, tgt_lang, unnest({toks("source")}) AS src_word FROM loc),
          tn AS (SELECT id, least(12, count(*)) AS n FROM tw JOIN lxk USING (src_lang, tgt_lang, src_word) GROUP BY 1),
          p AS (SELECT id, src_lang, tgt_lang, {plain("source")} AS plain FROM loc)
          SELECT p.id, coalesce(four.n, 0)::INT AS matches, tm_id, tm_percent, text, provider, percent, coalesce(tn.n, 0)::INT AS terms FROM p LEFT JOIN four USING (src_lang, tgt_lang, plain)
          LEFT JOIN sug USING (src_lang, tgt_lang, plain) LEFT JOIN tn ON tn.id = p.id""",
    }


def _documents() -> dict[str, str]:
    line = lambda c: rf"regexp_replace(regexp_replace({c}, '[\r\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"
    full = lambda c: f"regexp_replace(coalesce({c}, ''), '{SPACE}', '', 'g') <> ''"
    title = line("'File ' || coalesce(f.name, '?')")
    pairs = f"""al AS (SELECT f.id AS pair_id, {lang("p.src_lang")} AS src_lang, {lang("p.tgt_lang")} AS tgt_lang, seq, s.id AS seg, {line("source")} AS source, {line("target")} AS target
      FROM segments s JOIN files f ON f.id = s.file_id JOIN projects p ON p.id = f.project_id WHERE state IN {DONE} AND {full("source")} AND {full("target")}),
    whole AS (SELECT * FROM al UNION ALL SELECT DISTINCT pair_id, src_lang, tgt_lang, NULL::INT, NULL::BIGINT, {title}, {title} FROM al JOIN files f ON f.id = pair_id)"""
    return {
        "align_lines": f"WITH {pairs} SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY seg IS NOT NULL, seq, seg) - 1)::INT AS place, source, target FROM whole",
        "pair_import_counts": f"WITH {pairs} SELECT count(*) AS pairs_found, count(*) AS added FROM whole",
        "pair_import": f"""WITH {MEMORY}, {pairs}, a AS (SELECT src_lang, tgt_lang, source, target, origin, use_count, 0 AS later FROM mem
            UNION ALL SELECT src_lang, tgt_lang, {collapse("source")}, {collapse("target")}, 'corpus', 0, 1 FROM whole)
          SELECT src_lang, tgt_lang, source, target, min(struct_pack(i := later, o := origin)).o AS origin, (sum(use_count) + count(*) - 1)::BIGINT AS use_count FROM a GROUP BY src_lang, tgt_lang, source, target""",
    }


def _xliff() -> dict[str, str]:
    """Units of XLIFF 1.2 by patterns, as far as documents are written the plain way that these are."""
    attr = lambda c, name: rf"regexp_extract({c}, '\s{name}=\"([^\"]*)\"', 1)"
    inner = lambda name: rf"regexp_extract(u, '(?s)<{name}(?:\s[^>]*[^/>])?>(.*?)</{name}>', 1)"
    units = rf"""u AS (SELECT id AS file_id, doc, generate_subscripts(us, 1) AS n, unnest(us) AS u FROM (SELECT id, original AS doc, regexp_extract_all(original, '(?s)<trans-unit[\s>].*?</trans-unit>') AS us FROM files WHERE kind = 'xliff' AND original IS NOT NULL)),
    v AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY n)::INT AS seq, {attr("regexp_extract(doc, '<file[^>]*>')", "source-language")} AS src_lang, {attr("regexp_extract(doc, '<file[^>]*>')", "target-language")} AS tgt_lang,
      {attr("regexp_extract(u, '<trans-unit[^>]*>')", "id")} AS unit_id, {inner("source")} AS source, {inner("target")} AS target, {attr("regexp_extract(u, '<target[^>]*>')", "state")} AS st
      FROM u WHERE regexp_matches(u, '<source') AND {attr("regexp_extract(u, '<trans-unit[^>]*>')", "translate")} <> 'no')"""
    # markup whose tags are as many opening as closing stays, with empty elements closed at once; else it is text
    tags = lambda pattern: f"len(regexp_extract_all(l.target, '{pattern}'))"
    whole = rf"{tags('<[a-z](?:[^<>]*[^/<>])?>')} = {tags('</[a-z]+>')} AND {tags('<')} = {tags('</?[a-z][^<>]*>')} AND {tags('&')} = {tags('&(?:amp|lt|gt|quot|#[0-9]+);')}"
    text = "replace(replace(replace(l.target, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    put = rf"CASE WHEN {whole} THEN regexp_replace(l.target, '(<[a-z](?:[^<>]*[^/<>])?)></[a-z]+>', '\1/>', 'g') ELSE {text} END"
    state = "CASE WHEN st IN ('translated', 'signed-off', 'final') THEN 'translated' WHEN target <> '' THEN 'draft' ELSE 'new' END"
    return {
        "xliff_units": f"WITH {units} SELECT file_id, seq, src_lang, tgt_lang, unit_id, source, target, {state} AS state FROM v",
        "xliff_round_trip": f"""WITH {units}, last AS (SELECT DISTINCT ON (file_id, unit_id) file_id, unit_id, coalesce(target, '') AS target, coalesce(state, '') AS state FROM segments WHERE unit_id <> '' ORDER BY file_id, unit_id, seq DESC, id DESC),
          w AS (SELECT file_id, unit_id, coalesce({put}, v.target) AS target, CASE l.state WHEN 'draft' THEN 'new' WHEN 'translated' THEN 'translated' WHEN 'approved' THEN 'final' ELSE st END AS st
            FROM v LEFT JOIN last l USING (file_id, unit_id)) SELECT file_id, unit_id, target, {state} AS state FROM w""",
    }


def all_sql() -> dict[str, str]:
    progress = f"count(s.id) AS segments, count(s.id) FILTER (s.state IN {DONE}) AS done"
    escaped = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    top_lexicon = "SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, src_word ORDER BY prob DESC, tgt_word) AS k FROM lexicon"
    return {
        "tm_stats": f"SELECT {lang('src_lang')} AS src_lang, {lang('tgt_lang')} AS tgt_lang, count(*) AS units FROM tm_units GROUP BY ALL",
        "tm_upsert": f"WITH {MEMORY} SELECT * EXCLUDE (updated_at), epoch_us(updated_at) AS updated_us FROM mem",
        "tm_export": f"WITH {MEMORY} SELECT id, source, target FROM mem WHERE src_lang = 'en' AND tgt_lang = 'ru' ORDER BY id",
        "tm_exact": f"WITH {MEMORY}, {LOCATED}, q AS (SELECT DISTINCT src_lang, tgt_lang, {plain('source')} AS plain FROM (SELECT src_lang, tgt_lang, source FROM loc UNION ALL SELECT {lang('src_lang')}, {lang('tgt_lang')}, source FROM tm_units)) SELECT q.src_lang, q.tgt_lang, plain, id FROM q JOIN mem ON mem.src_lang = q.src_lang AND mem.tgt_lang = q.tgt_lang AND mem.source = plain",
        "tm_bm25_top80": f"WITH {MEMORY}, {LOCATED}, {ASKED}, {_bm25()} SELECT src_lang, tgt_lang, plain, id, round(bm25, 6) AS bm25, place FROM cand",
        "tm_lookup_prefix": _lookup(_ALL_HITS, "allhits"),
        "tm_lookup_top5": _lookup(f"{_bm25()}, {_BM_HITS}", "bmhits"),
        "concordance": _concordance("Sensor", "en", "ru"),
        "concordance_wildcard": _concordance("tighten%if", "en", "nl"),
        "project_progress": f"""SELECT p.id, CASE WHEN trim(coalesce(p.name, '')) = '' THEN 'Untitled' ELSE p.name END AS name, count(DISTINCT f.id) AS files, {progress}
          FROM projects p LEFT JOIN files f ON f.project_id = p.id LEFT JOIN segments s ON s.file_id = f.id GROUP BY p.id, p.name""",
        "file_progress": f"SELECT f.id, f.project_id, f.name, {progress} FROM files f LEFT JOIN segments s ON s.file_id = f.id GROUP BY f.id, f.project_id, f.name",
        "tokenize_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({toks('source')}) AS word FROM segments) GROUP BY 1",
        "norm_lang": f"SELECT {lang('lang')} AS lang, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1",
        "strip_tags_len": f"SELECT id, length({plain('source')})::INT AS plain_length, len({toks('source')})::INT AS words FROM segments",
        "segment_sentences": _sentences(),
        "repetitions": f"WITH {LOCATED}, {_FIRST} SELECT project_id, count(*) AS segments, sum(words)::BIGINT AS words FROM rep WHERE again GROUP BY 1",
        "volume_bands": _bands(_ALL_HITS, "allhits"),
        "volume_bands_bm25": _bands(f"{_bm25()}, {_BM_HITS}", "bmhits"),
        **_quality(),
        **_chain(),
        **_documents(),
        **_xliff(),
        "export_txt_parts": "SELECT file_id, seq // 5 AS part, string_agg(coalesce(nullif(target, ''), source, ''), chr(10) ORDER BY seq, id) AS content FROM segments GROUP BY ALL",
        "tmx_documents": f"""WITH {MEMORY}, l AS (SELECT id, src_lang, tgt_lang, '<tu><tuv xml:lang="' || src_lang || '"><seg>' || {escaped("source")} || '</seg></tuv><tuv xml:lang="'
            || tgt_lang || '"><seg>' || {escaped("target")} || '</seg></tuv></tu>' AS line FROM mem)
          SELECT src_lang, tgt_lang, 0 AS part, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<tmx version="1.4"><header creationtool="weftwork" creationtoolversion="1" segtype="sentence" o-tmf="none" adminlang="en" srclang="'
            || src_lang || '" datatype="plaintext" creationdate="20240101T000000Z"/><body>' || chr(10) || string_agg(line, chr(10) ORDER BY id) || chr(10) || '</body></tmx>' AS content FROM l GROUP BY src_lang, tgt_lang""",
        "lexicon_ibm1": _ibm1(),
        "lexicon_terms": f"""WITH {LOCATED}, w AS (SELECT id, src_lang, tgt_lang, src_word, min(place) AS place FROM
            (SELECT id, src_lang, tgt_lang, generate_subscripts(ts, 1) AS place, unnest(ts) AS src_word FROM (SELECT *, {toks("source")} AS ts FROM loc)) GROUP BY ALL),
          k AS (SELECT src_lang, tgt_lang, src_word, string_agg(tgt_word, ', ' ORDER BY k) AS translations FROM ({top_lexicon}) WHERE k <= 3 GROUP BY ALL),
          x AS (SELECT id, src_word, translations, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM w JOIN k USING (src_lang, tgt_lang, src_word))
          SELECT id, src_word, translations FROM x WHERE n <= 12""",
        "gloss": rf"""WITH {LOCATED}, {ASKED}, x AS (SELECT src_lang, tgt_lang, plain, generate_subscripts(ps, 1) AS place, unnest(ps) AS piece
            FROM (SELECT *, regexp_extract_all(plain, '{WORD}|[^\p{{L}}\p{{N}}_]+') AS ps FROM q)),
          k AS (SELECT src_lang, tgt_lang, src_word, tgt_word FROM ({top_lexicon}) WHERE k = 1),
          y AS (SELECT x.*, tgt_word, CASE WHEN tgt_word IS NULL THEN piece WHEN regexp_matches(piece, '^\p{{Lu}}') THEN upper(tgt_word[1:1]) || tgt_word[2:] ELSE tgt_word END AS word
            FROM x LEFT JOIN k ON k.src_lang = x.src_lang AND k.tgt_lang = x.tgt_lang AND k.src_word = lower(piece))
          SELECT src_lang, tgt_lang, plain, string_agg(word, '' ORDER BY place) AS gloss FROM y GROUP BY ALL HAVING count(tgt_word) > 0""",
        "export_txt": "SELECT file_id, string_agg(coalesce(nullif(target, ''), source, ''), chr(10) ORDER BY seq, id) AS content FROM segments GROUP BY 1",
        "tmx_lines": f"""WITH {MEMORY} SELECT id, src_lang, tgt_lang, '<tu><tuv xml:lang="' || src_lang || '"><seg>' || {escaped("source")} || '</seg></tuv><tuv xml:lang="'
          || tgt_lang || '"><seg>' || {escaped("target")} || '</seg></tuv></tu>' AS line FROM mem""",
        "tmx_round_trip": f"WITH {MEMORY} SELECT id AS doc_id, src_lang, tgt_lang, source, target FROM mem WHERE src_lang <> '' AND tgt_lang <> ''",
        "learn_settled": f"WITH {LOCATED}, {_LEARN} SELECT DISTINCT ON (segment_id) segment_id, target, state FROM e ORDER BY segment_id, ts DESC, event_id DESC",
        "learn_taught": f"WITH {LOCATED}, {_LEARN} SELECT * FROM taught",
        "learn_merged": f"""WITH {MEMORY}, {LOCATED}, {_LEARN} SELECT src_lang, tgt_lang, source, target, CASE WHEN m.id IS NULL THEN 'editor' ELSE m.origin END AS origin,
          (CASE WHEN m.id IS NULL THEN confirmations - 1 ELSE use_count + coalesce(confirmations, 0) END)::BIGINT AS use_count
          FROM mem m FULL JOIN taught USING (src_lang, tgt_lang, source, target)""",
        "project_deleted": """SELECT 'projects' AS name, count(*) AS n FROM projects WHERE id <> 1 UNION ALL SELECT 'files', count(*) FROM files WHERE project_id <> 1
          UNION ALL SELECT 'segments', count(*) FROM segments WHERE file_id NOT IN (SELECT id FROM files WHERE project_id = 1)""",
        "glossary_added": "SELECT src_lang, tgt_lang, src_term, tgt_term FROM glossary UNION SELECT src_lang, tgt_lang, src_word, tgt_word FROM lexicon",
        "tmx_import": f"""WITH {MEMORY}, a AS (SELECT src_lang, tgt_lang, source, target, origin, use_count, 0 AS later, 0 AS n FROM mem
            UNION ALL SELECT src_lang, tgt_lang, source, target, 'tmx', 0, 1, 1 FROM mem UNION ALL SELECT tgt_lang, src_lang, target, source, 'tmx', 0, 1, 1 FROM mem)
          SELECT src_lang, tgt_lang, source, target, min(struct_pack(i := later, o := origin)).o AS origin, (sum(use_count) + count(*) - 1)::BIGINT AS use_count
          FROM a GROUP BY src_lang, tgt_lang, source, target""",
        "stream_confirm_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, coalesce(state, 'unchanged') AS state, count(*) AS arrivals FROM confirm_events GROUP BY ALL",
        "stream_confirm_once": "SELECT DISTINCT event_id, segment_id, state FROM confirm_events",
    }
