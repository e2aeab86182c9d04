"""Queries of the operators for training data, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm.consistent import consistent_form, fields_of, out_of_form
from weftwork.llm.defects import pair_defects, pairs_of
from weftwork.llm.formcopies import copy_counts, form_copies
from weftwork.llm.garbled import find_garbled, records_of, restored
from weftwork.llm.mixing import mixed, share_report
from weftwork.llm.nearcopies import near_groups, near_pairs
from weftwork.llm.packing import containers, fill_report, placement_report
from weftwork.llm.pii import masked_documents, personal_data
from weftwork.llm.sentences import clean_sentences
from weftwork.llm.tokens import token_counts
from weftwork.session import cut
from weftwork.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _sized(s: SparkSession, d: str) -> DataFrame:
    return token_counts(table(s, d, "documents"), ["doc_id", "source"])


def _placed(s: SparkSession, d: str) -> DataFrame:
    sized, packs = cut(_sized(s, d)), table(s, d, "pack_sizes")
    return placement_report(cut(containers(sized, packs)), sized, packs)


def queries() -> dict[str, Query]:
    t = table
    pairs = lambda s, d: pairs_of(t(s, d, "tm_units"), t(s, d, "segments"), t(s, d, "files"), t(s, d, "projects"))
    return {
        "p1_found": lambda s, d: near_pairs(t(s, d, "tm_units")),
        "p1_groups": lambda s, d: near_groups(t(s, d, "tm_units")),
        "p2_found": lambda s, d: form_copies(t(s, d, "tm_units")),
        "p2_copies": lambda s, d: copy_counts(t(s, d, "tm_units")),
        "p3_found": lambda s, d: pair_defects(pairs(s, d)),
        "p4_found": lambda s, d: clean_sentences(t(s, d, "files"), t(s, d, "segments")),
        "p5_found": lambda s, d: find_garbled(records_of(t(s, d, "files"), t(s, d, "segments"))),
        "p5_restored": lambda s, d: restored(records_of(t(s, d, "files"), t(s, d, "segments"))),
        "p6_found": lambda s, d: out_of_form(t(s, d, "segments"), t(s, d, "tm_units")),
        "p6_forms": lambda s, d: consistent_form(fields_of(t(s, d, "segments"), t(s, d, "tm_units"))),
        "p7_containers": lambda s, d: containers(_sized(s, d), t(s, d, "pack_sizes")),
        "p7_fill": lambda s, d: fill_report(containers(_sized(s, d), t(s, d, "pack_sizes")), t(s, d, "pack_sizes")),
        "p7_placed": _placed,
        "p8_mixed": lambda s, d: mixed(_sized(s, d), t(s, d, "mix_targets")),
        "p8_shares": lambda s, d: share_report(_sized(s, d), t(s, d, "mix_targets")),
        "p9_found": lambda s, d: personal_data(t(s, d, "documents")),
        "p9_masked": lambda s, d: masked_documents(t(s, d, "documents")),
    }


def _lang(c: str) -> str:
    return f"split_part(replace(lower(trim(coalesce({c}, ''))), '_', '-'), '-', 1)"


def _folded(c: str) -> str:
    return rf"replace(lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')), 'ß', 'ss')"


_COPIES = f"""
WITH s AS (SELECT id, {_lang("src_lang")} || ':' || {_folded("source")} AS a, {_lang("tgt_lang")} || ':' || {_folded("target")} AS b,
             {_folded("source")} <> '' AND {_folded("target")} <> '' AS ok FROM tm_units WHERE id IS NOT NULL),
k AS (SELECT id, least(a, b) AS x, greatest(a, b) AS y FROM s WHERE ok),
g AS (SELECT id, min(id) OVER (PARTITION BY x, y) AS keep_id FROM k)
"""


def oracle_sql() -> dict[str, str]:
    words = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
    near = f"""
    WITH u AS (SELECT id, {_lang("src_lang")} || '>' || {_lang("tgt_lang")} AS langs, {words("source")} AS ws, {words("target")} AS wt,
                 {_folded("source")} AS fa, {_folded("target")} AS fb FROM tm_units),
    v AS (SELECT *, len(ws) AS ns, len(wt) AS nt FROM u WHERE len(ws) >= 8 AND len(wt) > 0),
    e AS (SELECT id, langs, ns, w, row_number() OVER (PARTITION BY id, w) AS k FROM (SELECT id, langs, ns, unnest(ws) AS w FROM v)),
    c AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM e x JOIN e y ON x.langs = y.langs AND x.w = y.w AND x.k = y.k AND x.id < y.id
            AND least(x.ns, y.ns) * 5 >= greatest(x.ns, y.ns) * 4 GROUP BY ALL),
    p AS (SELECT c.a, c.b FROM c JOIN v x ON x.id = c.a JOIN v y ON y.id = c.b
            WHERE c.n * 5 >= greatest(x.ns, y.ns) * 4 AND (x.fa <> y.fa OR x.fb <> y.fb)),
    f AS (SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM (SELECT id, unnest(wt) AS w FROM v)),
    d AS (SELECT p.a, p.b, count(*) AS n FROM p JOIN f x ON x.id = p.a JOIN f y ON y.id = p.b AND x.w = y.w AND x.k = y.k GROUP BY ALL)
    SELECT d.a AS id_a, d.b AS id_b FROM d JOIN v x ON x.id = d.a JOIN v y ON y.id = d.b WHERE d.n * 5 >= greatest(x.nt, y.nt) * 4
    """
    return {
        "p1_found": near,
        "p2_found": _COPIES + "SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
        "p2_copies": _COPIES
        + "SELECT i.id AS keep_id, coalesce(n, 1)::BIGINT AS copies FROM (SELECT DISTINCT id FROM tm_units WHERE id IS NOT NULL) i"
        + " LEFT JOIN (SELECT keep_id, count(*) AS n FROM g GROUP BY 1) c ON c.keep_id = i.id"
        + " WHERE i.id NOT IN (SELECT id FROM g WHERE id <> keep_id)",
        "p7_placed": "SELECT pack_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, 0::BIGINT AS lost_tokens, 0::BIGINT AS over_full, 0::BIGINT AS needless_splits"
        + " FROM (SELECT DISTINCT pack_name FROM pack_sizes WHERE capacity_tokens > 0)",
    }
