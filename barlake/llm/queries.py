"""The registered queries of the text operators: whole tables in, the stated columns out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, fixity, html_extract, jaccard, merkle_manifest, packing, quality_model, quality_rules, token_files, toxicity, url_filter, vector_codes
from .shared import load, shared_dir


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.measure(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits WARC archives written of all pages against a replica with known damage."""
    pages = load(spark, sf_dir, "pages")
    found = fixity.audit(fixity.archive_index(pages), fixity.archive_index(fixity.damaged_replica(pages)))
    return found.withColumnRenamed("key", "page_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(load(spark, sf_dir, "pages"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(load(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(load(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, each held against the edited text and the next document."""
    return fingerprints.compare_neighbours(load(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, held against a copy that lost line ends."""
    return merkle_manifest.audit(load(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with codebooks learned from all of them."""
    return vector_codes.compress(load(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_best_fit_packing, op3_merkle_fixity, op4_url_filter, op5_decontaminate,
        op6_html_extract, op7_quality_model, op8_token_files, op9_toxicity, op10_jaccard_join, op11_document_fingerprints, op12_merkle_manifest, op13_vector_codes,
    )
}

def _codes_sql(rounds: int) -> str:
    """Nearest entries by plain distances, and codebooks from their parts' floored means, round after round."""
    near = "(SELECT row, p, x, ARG_MIN(e, (d, e)) AS e, MIN(d) AS d FROM (SELECT row, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM pt JOIN {0} USING (p)) GROUP BY row, p, x)"
    mean = "(SELECT p, e, LIST(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(FLOOR(SUM(v) / COUNT(*)) AS BIGINT) AS m FROM (SELECT p, e, UNNEST(x) AS v, UNNEST(range(len(x))) AS i FROM {0}) GROUP BY p, e, i) GROUP BY p, e)"
    steps = [f"a{k} AS MATERIALIZED {near.format(f'c{k}')}, c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, COALESCE(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN {mean.format(f'a{k}')} m USING (p, e))" for k in range(rounds)]
    return f"""
WITH kv AS (SELECT vec_id, label, ROW_NUMBER() OVER () AS row, list_transform(embedding, lambda x: CAST(FLOOR(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS MATERIALIZED (SELECT vec_id, row, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kv CROSS JOIN (SELECT UNNEST(RANGE(4)) AS p)),
c0 AS (SELECT p, e, x AS c FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY vec_id, row) - 1 AS e FROM pt) WHERE e < 256), {', '.join(steps)}, z AS {near.format(f'c{rounds}')},
er AS (SELECT row, STRING_AGG(printf('%02x', e), '' ORDER BY p) AS code, CAST(SUM(d) AS BIGINT) AS error FROM z GROUP BY row), bk AS (SELECT sha256(STRING_AGG(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM c{rounds})
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM kv JOIN er USING (row), bk"""


_FIELD = "COALESCE(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle_manifest.FIELDS) + ")"
#: CRC-32 of the digits of a number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT))"""


def _tree_sql(name: str, rows: str) -> str:
    """Tables name (group, level, idx, hash, n) of all levels and name_s, each node's siblings left and right of it."""
    return f"""{name} AS (SELECT g, CAST(0 AS BIGINT) AS lvl, idx, h, n FROM {rows} UNION ALL SELECT g, lvl + 1, idx // 3, sha256(STRING_AGG(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 3, n),
{name}_s AS (SELECT a.g, a.lvl, a.idx, COALESCE(STRING_AGG(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, COALESCE(STRING_AGG(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a LEFT JOIN {name} b ON b.g IS NOT DISTINCT FROM a.g AND b.lvl = a.lvl AND b.idx // 3 = a.idx // 3 AND b.idx <> a.idx WHERE a.n > 1 GROUP BY a.g, a.lvl, a.idx)"""


_MANIFEST = f"""
WITH RECURSIVE h AS (SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.replace("CAST(text AS VARCHAR)", "replace(text, chr(10), '')")} ELSE {_LEAF} END AS copy FROM documents),
lf AS (SELECT *, ROW_NUMBER() OVER () AS row, source AS g, leaf AS h, CAST(ROW_NUMBER() OVER w - 1 AS BIGINT) AS idx, CAST(COUNT(*) OVER (PARTITION BY source) AS BIGINT) AS n FROM h WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
{_tree_sql('nd', 'lf')}, ro AS (SELECT g AS source, h AS subroot, 0 AS g, h, CAST(ROW_NUMBER() OVER (ORDER BY g NULLS FIRST) - 1 AS BIGINT) AS idx, CAST(COUNT(*) OVER () AS BIGINT) AS n FROM nd WHERE n = 1),
{_tree_sql('tp', 'ro')}, st AS (SELECT row, lvl, l, r FROM lf JOIN nd_s ON nd_s.g IS NOT DISTINCT FROM lf.g AND nd_s.idx = lf.idx // CAST(pow(3, lvl) AS BIGINT)
  UNION ALL SELECT row, 1000 + lvl, l, r FROM lf JOIN ro ON ro.source IS NOT DISTINCT FROM lf.source JOIN tp_s ON tp_s.idx = ro.idx // CAST(pow(3, lvl) AS BIGINT)),
pf AS (SELECT row, STRING_AGG(l || r, '' ORDER BY lvl) AS sib, LIST({{'l': l, 'r': r}} ORDER BY lvl) AS steps FROM st GROUP BY row),
al AS (SELECT doc_id, leaf, subroot, (SELECT h FROM tp WHERE n = 1) AS root, sha256(COALESCE(sib, '')) AS proof_sha256, CASE WHEN steps IS NULL THEN copy ELSE list_reduce(list_prepend({{'l': copy, 'r': ''}}, steps), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l END AS folded_root
  FROM lf JOIN ro ON ro.source IS NOT DISTINCT FROM lf.source LEFT JOIN pf ON pf.row = lf.row)
SELECT *, folded_root = root AS verified FROM al"""

_RECORD = (
    "'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || e"
    " || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: '"
    " || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e"
)

ORACLES: dict[str, str] = {
    "op1_quality_rules": r"""
with d as (select cast(doc_id as bigint) as doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines from d),
g as (select doc_id, unnest(range(1, greatest(len(words) - 1, 1))) as i, words from w where len(words) >= 3),
t as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from g),
r as (select doc_id, count(*) as n_repeat from (select distinct doc_id, unnest([i, i + 1, i + 2]) as p from t where n > 1) group by 1),
c as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(length(array_to_string(words, '')), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
  len(regexp_extract_all(text, '[!?]')) as marks, len(regexp_extract_all(text, '\p{Lu}{2,}')) as capitals,
  len(list_filter(words, lambda x: lower(x) in ({STOPS}))) as stops, cast(coalesce(n_repeat, 0) as bigint) as n_repeat_words
  from w left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed
  and word_chars / n_words between 2.0 and 12.0 and n_symbols / n_words <= 0.1 and marks / n_words <= 0.4
  and stops / n_words >= 0.02 and capitals / n_words <= 0.4 and n_dup_lines / n_lines <= 0.5 as kept from f""".replace("{STOPS}", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)),
    "op3_merkle_fixity": f"""
with p as (select page_id, url, html, chr(13) || chr(10) as e from pages),
q as (select page_id, url, case when page_id % 97 = 13 then left(html, greatest(length(html) - 1, 0)) else html end as html, e from p where page_id % 389 <> 7),
a as (select page_id, cast(floor(page_id / 4096) as bigint) as archive, cast(strlen({_RECORD}) as bigint) as length, sha256({_RECORD}) as s from p),
b as (select page_id, sha256({_RECORD}) as s from q),
o as (select *, cast(sum(length) over (partition by archive order by page_id) - length as bigint) as "offset" from a)
select o.page_id, archive, "offset", length, o.s as primary_sha256, b.s as replica_sha256, case when b.s is null then 'missing' else 'changed' end as status
from o left join b using (page_id) where b.s is null or b.s <> o.s""",
    "op4_url_filter": """
with u as (select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from u)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when regexp_matches(host, '(^|\\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') then 'block' else 'allow' end as verdict
from r""",
    "op12_merkle_manifest": _MANIFEST,
    "op13_vector_codes": _codes_sql(vector_codes.ROUNDS),
}
