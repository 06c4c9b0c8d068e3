"""DuckDB SQL equal in result to each registered query (the correctness gate).

RE2 has no look-behind or back-references, so two T2 steps are re-stated:
the numbering step runs twice with a captured preceding space, and the
repeated-symbol step runs once per ASCII symbol.
"""

from __future__ import annotations

from quire.plans import fixtures as fx
from quire.plans.oracle_values import (BOILERPLATE_RE, DEFAULT_RULE, FIELD_LABELS, LABELS_ALT, LANGUAGE_NAMES, LINE_BREAK,
                                       NOISE_KEYWORDS, NON_WS, PROMPT_TAIL, RED_FLAG_PATTERNS, RULES, SCRIPT_RANGES,
                                       TRANSLATE_SYSTEM, WS, WS_CHARS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {_q(WS + '+')}, ' ', 'g'))"


def _symbols() -> list[int]:
    ws = {9, 10, 11, 12, 13, 28, 29, 30, 31, 32}
    return [i for i in range(128) if not (chr(i).isalnum() or chr(i) == "_" or i in ws)]


def clean_document(x: str) -> str:
    e = f"coalesce({x}, '')"
    e = f"regexp_replace({e}, {_q('(?i)https?://' + NON_WS + '+|www[.]' + NON_WS + '+')}, ' ', 'g')"
    e = f"regexp_replace({e}, {_q(r'[(]' + WS + r'*\p{Nd}{1,4}' + WS + r'*[)]')}, ' ', 'g')"
    e = f"regexp_replace({e}, {_q(r'\[' + WS + r'*\p{Nd}{1,4}(?:' + WS + r'*,' + WS + r'*\p{Nd}{1,4})*' + WS + r'*\]')}, ' ', 'g')"
    for _ in range(2):
        e = f"regexp_replace({e}, {_q('(^|' + WS + r')\p{Nd}+[)]' + WS + '*')}, '\\1 ', 'g')"
    e = f"regexp_replace({e}, {_q(r'[^\x{00}-\x{7F}]+')}, ' ', 'g')"
    for i in _symbols():
        rep = "'\\\\'" if i == 92 else f"chr({i})"  # a lone backslash must be escaped in RE2 rewrites
        e = f"regexp_replace({e}, '\\x{{{i:02X}}}{{3,}}', {rep}, 'g')"
    e = f"regexp_replace({e}, '[_=:-]{{3,}}', ' ', 'g')"
    return f"trim(regexp_replace({e}, {_q(WS + '+')}, ' ', 'g'))"


def _word_count(t: str) -> str:
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END AS INTEGER)"


def _alpha_ratio(t: str) -> str:
    alpha = f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    vis = f"length(regexp_replace({t}, {_q(WS + '+')}, '', 'g'))"
    return f"CASE WHEN {vis} > 0 THEN {alpha} / {vis} ELSE 0.0 END"


def _boiler(t: str) -> str:
    return f"regexp_matches(lower({t}), {_q(BOILERPLATE_RE)})"


def _chunk_words_cte(src: str, cols: str, size: int, overlap: int, prefix: str = "") -> str:
    """CTE body: rows of ``src`` (with cleaned text column t) exploded to
    (cols..., chunk_index, chunk_text) by the C1 rule, in CTE ``{prefix}c``."""
    step = max(size - overlap, 1)
    return f"""
    {prefix}w AS (SELECT {cols}, t, string_split(t, ' ') AS words FROM {src} WHERE t <> ''),
    {prefix}g AS (SELECT {cols}, t, words,
                 unnest(generate_series(0, CASE WHEN len(words) <= {size} THEN 0
                        ELSE CAST(ceil((len(words) - {size}) / {step}.0) AS BIGINT) END)) AS i FROM {prefix}w),
    {prefix}c AS (SELECT {cols}, CAST(i AS INTEGER) AS chunk_index,
                 CASE WHEN len(words) <= {size} THEN t
                      ELSE array_to_string(words[i * {step} + 1 : i * {step} + {size}], ' ') END AS chunk_text
          FROM {prefix}g)"""


CONV = (f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL "
        f"SELECT * FROM (VALUES {fx.sql_values(fx.CONVERSATIONS)}) v(conv_id, turn, role, text))")
PAGES_ALL = (f"(SELECT page_id, url, html FROM pages UNION ALL "
             f"SELECT * FROM (VALUES {fx.sql_values(fx.PAGES)}) v(page_id, url, html))")
DOCS_ALL = (f"(SELECT doc_id, text FROM documents UNION ALL "
            f"SELECT * FROM (VALUES {fx.sql_values(fx.DOCUMENTS)}) v(doc_id, text))")

CLEAN_TEXT = f"SELECT doc_id, {clean('text')} AS text_clean FROM documents"

CLEAN_DOCUMENT_TEXT = f"SELECT doc_id, {clean_document('text')} AS text_clean FROM documents"

CHUNK_WORDS = f"""
WITH b AS (SELECT doc_id, {clean('text')} AS t FROM documents),
{_chunk_words_cte('b', 'doc_id', 350, 90)}
SELECT doc_id, chunk_index, chunk_text FROM c
"""

_DOC_BASE = f"""
b AS (SELECT sha256(concat_ws('||', 'text', coalesce(source, ''), '', coalesce(CAST(doc_id AS VARCHAR), ''),
                              coalesce(text, ''))) AS row_id,
             {clean('text')} AS t, 'text' AS source_type, source AS source_file,
             CAST(NULL AS INTEGER) AS page_number
      FROM documents)"""

BUILD_CHUNKS = f"""
WITH {_DOC_BASE},
{_chunk_words_cte('b', 'row_id, source_type, source_file, page_number', 350, 90)},
f AS (SELECT * FROM c
      WHERE length(trim(chunk_text)) > 0 AND {_word_count('chunk_text')} >= 10
        AND {_alpha_ratio('chunk_text')} >= 0.2 AND NOT {_boiler('chunk_text')})
SELECT row_id, sha256(concat_ws('||', row_id, CAST(chunk_index AS VARCHAR), chunk_text)) AS chunk_id,
       chunk_index, chunk_text, source_type, source_file, page_number
FROM f
"""

QUALITY_GATES = f"""
WITH d AS (SELECT doc_id, {clean('text')} AS t FROM {DOCS_ALL} AS documents)
SELECT doc_id, {_word_count('t')} AS word_count, {_alpha_ratio('t')} AS alpha_ratio,
       {_boiler('t')} AS is_boilerplate,
       ({_word_count('t')} >= 10 AND {_alpha_ratio('t')} >= 0.2 AND NOT {_boiler('t')}) AS passes
FROM d
"""

CHUNK_STATS = f"""
WITH k AS ({BUILD_CHUNKS})
SELECT source_file, count(*) AS n_rows,
       CAST(max(length(chunk_text)) AS INTEGER) AS max_len,
       CAST(min(length(chunk_text)) AS INTEGER) AS min_len,
       CAST(floor(avg(length(chunk_text))) AS INTEGER) AS avg_len,
       CAST(quantile_disc(length(chunk_text), 0.5) AS INTEGER) AS median_len
FROM k GROUP BY source_file
"""

_SUPPLIER_TEXT = clean("concat_ws(' | ', 's_suppkey: ' || coalesce(CAST(s_suppkey AS VARCHAR), ''), "
                       "'s_name: ' || coalesce(s_name, ''), "
                       "'s_nationkey: ' || coalesce(CAST(s_nationkey AS VARCHAR), ''), "
                       "'s_acctbal: ' || coalesce(CAST(s_acctbal AS VARCHAR), ''))")

ROW_TO_TEXT = f"SELECT s_suppkey, {_SUPPLIER_TEXT} AS record_text FROM supplier"

STAGING_CHUNKS = f"""
WITH r AS (SELECT {_SUPPLIER_TEXT} AS t FROM supplier)
SELECT sha256(concat_ws('||', 'supplier.csv', '0', t)) AS id, t AS text_chunk, 'csv' AS source_type,
       CAST(to_json({{'file_name': 'supplier.csv', 'record_type': 'csv_row', 'chunk_index': CAST(0 AS INTEGER)}})
            AS VARCHAR) AS metadata
FROM r WHERE t <> ''
"""


def _script_struct(code: str, lo: int, hi: int) -> str:
    cls = f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}"
    return (f"{{'n': length(regexp_replace(coalesce(text, ''), '[^{cls}]', '', 'g')), "
            f"'neg_first': -length(regexp_extract(coalesce(text, ''), '^[^{cls}]*', 0)), 'code': '{code}'}}")


_NAME_CASE = "CASE " + " ".join(f"WHEN lang_code = '{c}' THEN '{n}'" for c, n in LANGUAGE_NAMES.items()) + \
    " ELSE lang_code END"

DETECT_LANGUAGE = f"""
WITH s AS (SELECT conv_id, turn, list_max([{', '.join(_script_struct(c, lo, hi) for c, _n, lo, hi in SCRIPT_RANGES)}])
                  AS best FROM {CONV} AS conversations),
l AS (SELECT conv_id, turn, CASE WHEN best.n > 0 THEN best.code ELSE 'en' END AS lang_code FROM s)
SELECT conv_id, turn, lang_code, {_NAME_CASE} AS lang_name FROM l
"""

RED_FLAGS = f"""
SELECT conv_id, turn, regexp_matches(coalesce(text, ''), {_q('(?i)' + '|'.join(RED_FLAG_PATTERNS))}) AS flagged
FROM {CONV} AS conversations
"""


def _rules_values() -> str:
    rows = []
    for i, (disease, kws, dosha, advice) in enumerate(RULES):
        rows.append(f"({i}, {_q(disease)}, [{', '.join(_q(k) for k in kws)}], [{', '.join(_q(d) for d in dosha)}], "
                    f"{_q(advice)})")
    return ", ".join(rows)


MATCH_RULES = f"""
WITH q AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS toks
           FROM {CONV} AS conversations WHERE role = 'user'),
r AS (SELECT * FROM (VALUES {_rules_values()}) AS r(ord, disease, kws, dosha, advice)),
s AS (SELECT q.conv_id, q.turn, r.ord, r.disease, r.dosha, r.advice, len(r.kws) AS nk,
             list_filter(r.kws, lambda k: list_contains(q.toks, k)) AS hits
      FROM q CROSS JOIN r),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(hits) DESC, ord) AS rn FROM s)
SELECT conv_id, turn,
       CASE WHEN len(hits) > 0 THEN disease ELSE {_q(DEFAULT_RULE[0])} END AS disease,
       CASE WHEN len(hits) > 0 THEN dosha ELSE [{', '.join(_q(d) for d in DEFAULT_RULE[1])}] END AS dosha,
       CASE WHEN len(hits) > 0 THEN advice ELSE {_q(DEFAULT_RULE[2])} END AS advice,
       CASE WHEN len(hits) > 0 THEN hits ELSE CAST([] AS VARCHAR[]) END AS matched_keywords,
       CASE WHEN len(hits) > 0 THEN round_even(len(hits) / nk, 2) ELSE 0.0 END AS confidence
FROM b WHERE rn = 1
"""

VALIDATE_QUESTIONS = rf"""
WITH v AS (SELECT conv_id, turn,
                  CASE WHEN text IS NULL THEN 'question is required'
                       WHEN length(text) < 3 THEN 'question shorter than 3 characters'
                       WHEN length(text) > 2000 THEN 'question longer than 2000 characters'
                       WHEN regexp_full_match(text, '[\t-\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]*') THEN 'question is blank' END AS reason
           FROM {CONV} AS conversations WHERE role = 'user')
SELECT conv_id, turn, reason IS NULL AS is_valid, reason FROM v
"""

_STRIPPED = f"regexp_replace(coalesce(text, ''), {_q('^' + WS + '+|' + WS + '+$')}, '', 'g')"
SNIPPETS = f"""
WITH s AS (SELECT doc_id, {_STRIPPED} AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 600 THEN regexp_replace(substr(x, 1, 600), ' [^ ]*$', '') || ' …'
                    ELSE x END AS snippet
FROM s
"""

ORACLE = {
    "clean_text": CLEAN_TEXT,
    "clean_document_text": CLEAN_DOCUMENT_TEXT,
    "chunk_words": CHUNK_WORDS,
    "build_chunks": BUILD_CHUNKS,
    "quality_gates": QUALITY_GATES,
    "chunk_stats": CHUNK_STATS,
    "row_to_text": ROW_TO_TEXT,
    "staging_chunks": STAGING_CHUNKS,
    "detect_language": DETECT_LANGUAGE,
    "red_flags": RED_FLAGS,
    "match_rules": MATCH_RULES,
    "validate_questions": VALIDATE_QUESTIONS,
    "snippets": SNIPPETS,
}


# ---------------------------------------------------------------------------
# embeddings and retrieval
# ---------------------------------------------------------------------------

TERMS_RE = r"[\p{L}\p{N}']+"
EMBED_DIM = 128
RETRIEVAL_K = 20


def _terms(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {_q(TERMS_RE)})"


def hashed_embedding_cte(name: str, src: str, key: str, text: str, dim: int = EMBED_DIM) -> str:
    """CTE ``name``(key, v DOUBLE[]) = L2-normalised hashed term counts."""
    return f"""
{name}_t AS (SELECT {key}, {_terms(text)} AS toks FROM {src}),
{name}_c AS (SELECT {key}, b, count(*) AS n FROM
      (SELECT {key}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {dim} AS b
       FROM (SELECT {key}, unnest(toks) AS tok FROM {name}_t)) GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM {name}_c GROUP BY {key}),
{name}_g AS (SELECT t.{key}, d.d FROM {name}_t t CROSS JOIN range({dim}) d(d)),
{name} AS (SELECT g.{key}, list(CAST(CAST(coalesce(CAST(c.n AS DOUBLE) / nn.norm, 0.0) AS FLOAT) AS DOUBLE)
                                ORDER BY g.d) AS v
      FROM {name}_g g LEFT JOIN {name}_c c ON c.{key} = g.{key} AND c.b = g.d
      LEFT JOIN {name}_n nn ON nn.{key} = g.{key} GROUP BY g.{key})"""


EMBED_HASHING = f"""
WITH {hashed_embedding_cte('e', 'documents', 'doc_id', 'text')}
SELECT doc_id, CAST(v AS FLOAT[]) AS embedding FROM e
"""

KNN_CENTROIDS = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT label, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS x FROM e),
c AS (SELECT label, list(x ORDER BY pos) AS cv FROM (SELECT label, pos, avg(x) AS x FROM p GROUP BY label, pos)
      GROUP BY label),
s AS (SELECT c.label, e.vec_id, round(list_cosine_similarity(c.cv, e.v), 6) AS score FROM c CROSS JOIN e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {RETRIEVAL_K}
"""

KNN_SELF = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_vec_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_vec_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""


def _chunks_cte() -> str:
    body = BUILD_CHUNKS.strip()
    assert body.startswith("WITH ")
    return body[len("WITH "):].replace("\nSELECT row_id, sha256", ",\nk AS (SELECT row_id, sha256", 1) + ")"


def bm25_ctes(k: int) -> str:
    """CTEs ending in ``kw``(item_id, chunk_id, score, rank) over chunks ``k``."""
    return f"""
dt AS (SELECT chunk_id, {_terms('chunk_text')} AS toks FROM k),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(avg(len(toks)) AS DOUBLE) AS avgdl FROM dt),
post AS (SELECT chunk_id, tok AS term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS tok FROM dt) GROUP BY ALL),
dl AS (SELECT chunk_id, len(toks) AS dl FROM dt),
dft AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark)),
qw AS (SELECT qt.item_id, qt.term,
              ln(1.0::DOUBLE + (st.n - dft.df + 0.5::DOUBLE) / (dft.df + 0.5::DOUBLE)) AS idf
       FROM qt JOIN dft USING (term) CROSS JOIN st),
sc AS (SELECT qw.item_id, post.chunk_id,
              round(sum(qw.idf * post.tf * 2.2::DOUBLE
                        / (post.tf + 1.2::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE
                                                    + 0.75::DOUBLE * dl.dl / st.avgdl))), 6) AS score
       FROM qw JOIN post USING (term) JOIN dl USING (chunk_id) CROSS JOIN st GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank
                      FROM sc) WHERE rank <= {k})"""


BM25 = f"""
WITH {_chunks_cte()},
{bm25_ctes(RETRIEVAL_K)}
SELECT item_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM kw
"""


def vector_ctes(k: int) -> str:
    """CTEs ending in ``vh``(item_id, chunk_id, score, rank)."""
    return f"""
{hashed_embedding_cte('ce', 'k', 'chunk_id', 'chunk_text')},
{hashed_embedding_cte('qe', 'benchmark', 'item_id', 'text')},
vs AS (SELECT qe.item_id, ce.chunk_id,
              round(CASE WHEN list_dot_product(qe.v, qe.v) = 0 OR list_dot_product(ce.v, ce.v) = 0 THEN 0.0
                         ELSE list_cosine_similarity(qe.v, ce.v) END, 6) AS score
       FROM qe CROSS JOIN ce WHERE list_dot_product(qe.v, qe.v) > 0),
vh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank
                      FROM vs) WHERE rank <= {k})"""


HYBRID = f"""
WITH {_chunks_cte()},
{bm25_ctes(RETRIEVAL_K)},
{vector_ctes(RETRIEVAL_K)},
fu AS (SELECT coalesce(vh.item_id, kw.item_id) AS item_id, coalesce(vh.chunk_id, kw.chunk_id) AS chunk_id,
              coalesce(1.0::DOUBLE / (60 + vh.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0.0::DOUBLE)
                AS score
       FROM vh FULL OUTER JOIN kw ON vh.item_id = kw.item_id AND vh.chunk_id = kw.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM fu)
SELECT item_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {RETRIEVAL_K}
"""

ORACLE.update({
    "embed_hashing": EMBED_HASHING,
    "knn_centroids": KNN_CENTROIDS,
    "knn_self": KNN_SELF,
    "bm25": BM25,
    "hybrid": HYBRID,
})


# ---------------------------------------------------------------------------
# pages and index sync
# ---------------------------------------------------------------------------

_LINE_TAGS = ("address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|"
              "li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul")


def html_lines(x: str) -> str:
    e = f"coalesce({x}, '')"
    e = (f"regexp_replace({e}, {_q(r'(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->')}, "
         f"' ', 'g')")
    e = f"regexp_replace({e}, '(?is)</?(?:{_LINE_TAGS})\\b[^>]*>', chr(10), 'g')"
    e = f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
                    ("&amp;", "&")):
        e = f"replace({e}, {_q(ent)}, {_q(ch)})"
    return e


def html_text(x: str) -> str:
    return clean(html_lines(x))


_PAGE_NO = r"regexp_extract(url, '[?&]page=(\d{1,9})(?:[&#]|$)', 1)"
_PAGES = f"""
p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS doc_url,
             coalesce(CASE WHEN {_PAGE_NO} <> '' THEN CAST({_PAGE_NO} AS INTEGER) END, 1) AS page_number,
             {html_text('html')} AS page_text
      FROM {PAGES_ALL} AS pages)"""
_PAGE_LINES = _PAGES.replace(html_text('html'), html_lines('html'))

PAGE_DOCUMENTS = f"""
WITH {_PAGES},
k AS (SELECT doc_url, page_number, {_STRIPPED.replace('coalesce(text', 'coalesce(page_text')} AS x FROM p),
f AS (SELECT * FROM k WHERE length(x) > 0)
SELECT doc_url, CAST(count(*) AS INTEGER) AS page_count,
       string_agg(x, chr(10) || chr(10) ORDER BY page_number, x) AS document_text
FROM f GROUP BY doc_url
"""

PAGE_RECORDS = f"""
WITH {_PAGES},
c AS (SELECT doc_url, page_number, {clean_document('page_text')} AS cleaned FROM p),
r AS (SELECT doc_url AS source_file, page_number,
             CASE WHEN cleaned = '' THEN '' ELSE {clean("'Source File: ' || coalesce(nullif(doc_url, ''), 'unknown_file') || ' | Page Number: ' || CAST(page_number AS VARCHAR) || ' | ' || cleaned")} END
               AS raw_text
      FROM c)
SELECT * FROM r WHERE length(trim(raw_text)) > 0
"""

_SYNC = f"""
b AS (SELECT doc_id, {clean('text')} AS t FROM documents),
{_chunk_words_cte('b', 'doc_id', 350, 90, 'o')},
{_chunk_words_cte('b', 'doc_id', 400, 100, 'n')},
ch AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.chunk_index, o.chunk_index) AS chunk_index,
              CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete'
                   WHEN n.chunk_text <> o.chunk_text THEN 'update' ELSE 'unchanged' END AS op
       FROM nc n FULL OUTER JOIN oc o ON n.doc_id = o.doc_id AND n.chunk_index = o.chunk_index)"""

INDEX_SYNC = f"""
WITH {_SYNC}
SELECT doc_id, chunk_index, op FROM ch
"""

INDEX_STATUS = f"""
WITH {_SYNC}
SELECT CAST(sum(CASE WHEN op <> 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS indexed,
       CAST(sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CAST(sum(CASE WHEN op = 'update' THEN 1 ELSE 0 END) AS BIGINT) AS stale,
       CAST(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) AS BIGINT) AS extra,
       (sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN op = 'update' THEN 1 ELSE 0 END) = 0)
         AS ready
FROM ch
"""

ORACLE.update({
    "page_documents": PAGE_DOCUMENTS,
    "page_records": PAGE_RECORDS,
    "index_sync": INDEX_SYNC,
    "index_status": INDEX_STATUS,
})


PROMPTS = f"""
WITH {_chunks_cte()},
{bm25_ctes(5)},
ctx AS (SELECT kw.item_id, string_agg('[Source: ' || coalesce(k.source_file, 'unknown') || ', Page: '
                                      || coalesce(CAST(k.page_number AS VARCHAR), 'None') || '] ' || k.chunk_text,
                                      chr(10) || chr(10) ORDER BY kw.rank) AS block
        FROM kw JOIN k USING (chunk_id) GROUP BY kw.item_id)
SELECT b.item_id, 'Context:' || chr(10) || CASE WHEN coalesce(ctx.block, '') = '' THEN '(no context)' ELSE ctx.block END
       || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || {_q(PROMPT_TAIL)} AS prompt
FROM benchmark b LEFT JOIN ctx USING (item_id)
"""

ORACLE["prompts"] = PROMPTS


STREAM_SYNC = f"""
WITH b AS (SELECT doc_id, {clean('text')} AS t FROM documents),
{_chunk_words_cte('b', 'doc_id', 400, 100, 'n')}
SELECT doc_id, chunk_index, chunk_text FROM nc
"""

ORACLE["stream_sync"] = STREAM_SYNC



def _part(label: str, x: str) -> str:
    v = clean(x)
    return f"CASE WHEN trim({v}) <> '' THEN '{label}: ' || {v} END"


LABELLED_RECORDS = f"""
WITH r AS (SELECT c_custkey, concat_ws(' | ', 'Source: csv', {_part('Name', 'c_name')},
                                      {_part('Segment', 'c_mktsegment')},
                                      {_part('Balance', 'CAST(c_acctbal AS VARCHAR)')},
                                      'Source File: customer.csv') AS raw_text
           FROM customer)
SELECT sha256(concat_ws('||', 'csv', 'customer.csv', '', CAST(c_custkey AS VARCHAR), raw_text)) AS row_id,
       raw_text, 'csv' AS source_type, 'customer.csv' AS source_file
FROM r
"""

SOURCE_COUNTS_SQL = f"""
WITH k AS ({BUILD_CHUNKS})
SELECT source_file, count(*) AS n_rows, CAST(avg(length(chunk_text)) AS DOUBLE) AS avg_len
FROM k GROUP BY source_file
"""

EMBEDDING_CHECK = """
WITH embeddings AS (
  SELECT vec_id, embedding FROM embeddings UNION ALL
  SELECT * FROM (VALUES (-1, CAST(NULL AS FLOAT[])), (-2, CAST([1, 1, 1] AS FLOAT[])),
    (-3, list_transform(range(64), lambda i: CAST('inf' AS FLOAT))), (-6, list_transform(range(64), lambda i: CAST('-inf' AS FLOAT))),
    (-4, list_transform(range(64), lambda i: CAST('nan' AS FLOAT))), (-5, list_transform(range(64), lambda i: CAST(NULL AS FLOAT)))))
SELECT vec_id, CASE WHEN embedding IS NULL THEN 'null vector'
                    WHEN len(embedding) <> 64 THEN 'dimension ' || CAST(len(embedding) AS VARCHAR) || ' != 64'
                    WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'null or non-finite element'
               END AS reason
FROM embeddings
"""

STAGING_TO_PROCESSED = f"""
WITH s AS ({STAGING_CHUNKS})
SELECT sha256(concat_ws('||', source_type, json_extract_string(metadata, '$.file_name'),
                        json_extract_string(metadata, '$.chunk_index'), text_chunk)) AS row_id,
       id AS chunk_id, CAST(json_extract(metadata, '$.chunk_index') AS INTEGER) AS chunk_index,
       text_chunk AS chunk_text, source_type, json_extract_string(metadata, '$.file_name') AS source_file,
       CAST(NULL AS INTEGER) AS page_number
FROM s
"""

PREVIEW = f"""
WITH k AS ({BUILD_CHUNKS})
SELECT chunk_id, chunk_index, source_file FROM k ORDER BY chunk_id LIMIT 20
"""

ORACLE.update({
    "labelled_records": LABELLED_RECORDS,
    "source_counts_sql": SOURCE_COUNTS_SQL,
    "embedding_check": EMBEDDING_CHECK,
    "staging_to_processed": STAGING_TO_PROCESSED,
    "preview": PREVIEW,
})


# ---------------------------------------------------------------------------
# C2 sentence chunks: units by inserted separators, a list_reduce fold over
# unit word counts that carries word ranges, then one slice per chunk
# ---------------------------------------------------------------------------

def chunk_sentences_sql(size: int = 350, overlap: int = 70) -> str:
    step = size - overlap
    ws = WS
    rng = "STRUCT(s BIGINT, e BIGINT)[]"
    zero = f"{{'out': CAST([] AS {rng}), 'bs': CAST(0 AS BIGINT), 'bw': CAST(0 AS BIGINT), 'pos': CAST(0 AS BIGINT), 'wc': CAST(0 AS BIGINT)}}"
    flushed = "CASE WHEN acc.bw > 0 THEN list_append(acc.out, {'s': acc.bs, 'e': acc.pos}) ELSE acc.out END"
    windows = (f"list_transform(range(0, CAST(ceil((x.wc - {size}) / {step}.0) AS BIGINT) + 1), "
               f"lambda j: {{'s': acc.pos + j * {step}, 'e': least(acc.pos + j * {step} + {size}, acc.pos + x.wc)}})")
    fold = f"""list_reduce(
        list_transform(wc, lambda c: {{'out': CAST([] AS {rng}), 'bs': CAST(0 AS BIGINT), 'bw': CAST(0 AS BIGINT),
                                       'pos': CAST(0 AS BIGINT), 'wc': CAST(c AS BIGINT)}}),
        lambda acc, x: CASE
          WHEN x.wc > {size} THEN {{'out': list_concat({flushed}, {windows}), 'bs': acc.pos + x.wc,
                                    'bw': CAST(0 AS BIGINT), 'pos': acc.pos + x.wc, 'wc': CAST(0 AS BIGINT)}}
          WHEN acc.bw + x.wc <= {size} THEN {{'out': acc.out, 'bs': CASE WHEN acc.bw = 0 THEN acc.pos ELSE acc.bs END,
                                    'bw': acc.bw + x.wc, 'pos': acc.pos + x.wc, 'wc': CAST(0 AS BIGINT)}}
          ELSE {{'out': {flushed}, 'bs': acc.pos, 'bw': x.wc, 'pos': acc.pos + x.wc, 'wc': CAST(0 AS BIGINT)}}
        END,
        {zero})"""
    units = (f"flatten(list_transform(regexp_split_to_array(coalesce(text, ''), {_q(chr(92) + 'n' + ws + '*' + chr(92) + 'n')}), "
             f"lambda p: string_split(regexp_replace(p, {_q('([.?!])' + ws + '+([A-Z0-9' + chr(34) + chr(39) + '(])')}, "
             f"'\\1' || chr(1) || '\\2', 'g'), chr(1))))")
    counts = (f"list_filter(list_transform({units}, lambda s: len(list_filter(regexp_split_to_array(s, {_q(ws + '+')}), "
              f"lambda z: z <> ''))), lambda k: k > 0)")
    return f"""
WITH d AS (SELECT doc_id, text, {clean('text')} AS t FROM documents),
w AS (SELECT doc_id, text, t, string_split(t, ' ') AS words FROM d WHERE t <> ''),
short AS (SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, t AS chunk_text FROM w WHERE len(words) <= {size}),
u AS (SELECT doc_id, words, {counts} AS wc FROM w WHERE len(words) > {size}),
f AS (SELECT doc_id, words, {fold} AS st FROM u),
r AS (SELECT doc_id, words, CASE WHEN st.bw > 0 THEN list_append(st.out, {{'s': st.bs, 'e': st.pos}}) ELSE st.out END AS rg
      FROM f),
g AS (SELECT doc_id, words, rg, unnest(generate_series(1, len(rg))) AS i FROM r),
longc AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index,
                 array_to_string(CASE WHEN i = 1 OR {overlap} = 0 THEN words[rg[i].s + 1 : rg[i].e]
                      ELSE list_concat(words[greatest(rg[i - 1].s, rg[i - 1].e - {overlap}) + 1 : rg[i - 1].e],
                                       words[rg[i].s + 1 : rg[i].e]) END, ' ') AS chunk_text
          FROM g)
SELECT * FROM short UNION ALL SELECT * FROM longc
"""


ORACLE["chunk_sentences"] = chunk_sentences_sql(350, 70)


# ---------------------------------------------------------------------------
# M4 retrieve: hybrid top-20 candidates re-ranked by MMR (lambda 0.5, top 5).
# Bag-of-words cosines form a per-question matrix; a list_reduce appends the
# first index of the best marginal score k times.
# ---------------------------------------------------------------------------

def retrieve_sql(top_k: int = 5, lam: float = 0.5) -> str:
    hybrid_body = HYBRID.strip()[len("WITH "):]
    hybrid_ctes = hybrid_body[:hybrid_body.rindex("\nSELECT item_id, chunk_id, score")]
    ws = _q(WS + "+")
    vals = (f"list_transform(range(1, rl.n + 1), lambda i: CASE WHEN list_contains(picked, i) THEN CAST('-inf' AS DOUBLE) "
            f"ELSE {lam} * rl.rel[i] - (1.0 - {lam}) * coalesce(list_max(list_transform(picked, lambda j: mt.sim[i][j])), 0.0) END)")
    return f"""
WITH {hybrid_ctes},
cand AS (SELECT r.item_id, r.chunk_id, r.score, r.rank, k.chunk_text FROM r JOIN k USING (chunk_id)
         WHERE r.rank <= {RETRIEVAL_K}),
bw_tok AS (SELECT item_id, rank, unnest(list_filter(regexp_split_to_array(lower(chunk_text), {ws}), lambda z: z <> '')) AS w
        FROM cand),
tc AS (SELECT item_id, rank, w, CAST(count(*) AS DOUBLE) AS n FROM bw_tok GROUP BY ALL),
nrm AS (SELECT item_id, rank, sqrt(sum(n * n)) AS norm FROM tc GROUP BY ALL),
bw_dot AS (SELECT a.item_id, a.rank AS i, b.rank AS j, sum(a.n * b.n) AS d
       FROM tc a JOIN tc b ON a.item_id = b.item_id AND a.w = b.w GROUP BY ALL),
pairs AS (SELECT c1.item_id, c1.rank AS i, c2.rank AS j,
                 CASE WHEN coalesce(n1.norm, 0) * coalesce(n2.norm, 0) = 0 THEN 0.0
                      ELSE coalesce(bw_dot.d, 0.0) / (n1.norm * n2.norm) END AS sim
          FROM cand c1 JOIN cand c2 ON c1.item_id = c2.item_id
          LEFT JOIN bw_dot ON bw_dot.item_id = c1.item_id AND bw_dot.i = c1.rank AND bw_dot.j = c2.rank
          LEFT JOIN nrm n1 ON n1.item_id = c1.item_id AND n1.rank = c1.rank
          LEFT JOIN nrm n2 ON n2.item_id = c2.item_id AND n2.rank = c2.rank),
sm AS (SELECT item_id, i, list(sim ORDER BY j) AS srow FROM pairs GROUP BY item_id, i),
mt AS (SELECT item_id, list(srow ORDER BY i) AS sim FROM sm GROUP BY item_id),
rl AS (SELECT item_id, count(*) AS n, list(coalesce(score, 0.0) ORDER BY rank) AS sc FROM cand GROUP BY item_id),
rl2 AS (SELECT item_id, n, CASE WHEN list_max(sc) > 0 THEN list_transform(sc, lambda x: x / list_max(sc)) ELSE sc END AS rel
        FROM rl),
sel AS (SELECT rl.item_id,
               CASE WHEN rl.n <= {top_k} THEN CAST(range(1, rl.n + 1) AS BIGINT[])
                    ELSE list_reduce(list_transform(range({top_k}), lambda z: CAST([] AS BIGINT[])),
                                     lambda picked, z: list_append(picked, list_position({vals}, list_max({vals}))),
                                     CAST([] AS BIGINT[])) END AS picked
        FROM rl2 rl JOIN mt USING (item_id)),
o AS (SELECT item_id, picked, unnest(generate_series(1, len(picked))) AS mmr_rank FROM sel)
SELECT o.item_id, c.chunk_id, c.score, CAST(o.mmr_rank AS INTEGER) AS mmr_rank
FROM o JOIN cand c ON c.item_id = o.item_id AND c.rank = o.picked[o.mmr_rank]
"""


ORACLE["retrieve"] = retrieve_sql()


# ---------------------------------------------------------------------------
# T5 structured page text (staged CTEs: useful lines -> T2 -> fields -> parts)
# ---------------------------------------------------------------------------

def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def _noise(ln: str) -> str:
    low = _strip(f"lower({ln})")
    kws = " OR ".join(f"contains({low}, {_q(k)})" for k in NOISE_KEYWORDS)
    digits = f"regexp_matches({low}, {_q(chr(94) + '[' + chr(92) + '[' + chr(92) + ']' + chr(92) + '(' + chr(92) + ')' + chr(92) + 'p{Nd},' + chr(92) + '.' + WS_CHARS + chr(92) + '-:;]+$')})"
    return f"({low} = '' OR {kws} OR {digits})"


def _field(x: str, labels) -> str:
    stop = f"(?i){WS}+\\b(?:{LABELS_ALT})\\b{WS}*[:\\-].*$"
    picks = []
    for lab in labels:
        pat = f"(?i)\\b{lab.replace(' ', WS + '+')}\\b{WS}*[:\\-]{WS}*(.*)$"
        val = clean(f"substr(regexp_replace(regexp_extract({x}, {_q(pat)}, 1), {_q(stop)}, ''), 1, 220)")
        picks.append(f"CASE WHEN length({val}) >= 5 THEN {val} END")
    return f"coalesce({', '.join(picks)}, '')"


def _words(x: str) -> str:
    return f"CASE WHEN {clean(x)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({clean(x)}, ' ') END"


def _tpart(label: str, v: str, default: str) -> str:
    return f"CASE WHEN {v} <> '' THEN '{label}: ' || {v} ELSE '{label}: {default}' END"


PAGE_STRUCTURED = f"""
WITH {_PAGE_LINES},
ul AS (SELECT doc_url, page_number,
              list_filter(list_transform(regexp_split_to_array(coalesce(page_text, ''), {_q(LINE_BREAK)}),
                                         lambda x: {_strip('x')}), lambda ln: NOT {_noise('ln')}) AS lines
       FROM p),
fl AS (SELECT doc_url, page_number, {clean_document("array_to_string(lines, ' ')")} AS filtered FROM ul),
fd AS (SELECT doc_url, page_number, filtered,
              {', '.join(f"{_field('filtered', labs)} AS f_{k}" for k, labs in FIELD_LABELS.items())}
       FROM fl),
tx AS (SELECT doc_url AS source_file, page_number,
              CASE WHEN filtered = '' THEN '' ELSE {clean("concat_ws(' | ', " + ", ".join([
                  _tpart('Ingredient', "CASE WHEN f_ingredient <> '' THEN f_ingredient ELSE array_to_string((" + _words("split_part(filtered, '.', 1)") + ")[1:8], ' ') END", 'Unknown'),
                  _tpart('Botanical Name', 'f_botanical', 'Not specified'),
                  _tpart('Characteristics', 'f_characteristics', 'Not specified'),
                  _tpart('Uses', "CASE WHEN f_uses <> '' THEN f_uses ELSE array_to_string(string_split(filtered, ' ')[1:40], ' ') END", 'Not specified'),
                  _tpart('Kitchen Use', 'f_kitchen_use', 'Not specified'),
                  _tpart('Ayurvedic Use', 'f_ayurvedic_use', 'Not specified'),
                  _tpart('Remedies', 'f_remedies', 'Not specified'),
                  "'Source File: ' || coalesce(nullif(doc_url, ''), 'unknown_file')",
                  "'Page Number: ' || coalesce(CAST(page_number AS VARCHAR), 'unknown')"]) + ")")} END AS raw_text
       FROM fd)
SELECT * FROM tx WHERE length(trim(raw_text)) > 0
"""

ORACLE["page_structured"] = PAGE_STRUCTURED


_SYS_HEAD, _rest = TRANSLATE_SYSTEM.split("{src}")
_SYS_MID, _SYS_TAIL = _rest.split("{dst}")
TRANSLATION_MESSAGES = f"""
WITH l AS ({DETECT_LANGUAGE.strip()})
SELECT c.conv_id, c.turn,
       CAST(to_json([{{'role': 'system', 'content': {_q(_SYS_HEAD)} || lang_name || {_q(_SYS_MID)} || 'Telugu' || {_q(_SYS_TAIL)}}},
                     {{'role': 'user', 'content': c.text}}]) AS VARCHAR) AS messages
FROM {CONV} c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn
WHERE c.role = 'user'
"""

ORACLE["translation_messages"] = TRANSLATION_MESSAGES


# ---------------------------------------------------------------------------
# lookups, labels, several pages per document, the build from files
# ---------------------------------------------------------------------------

LANGUAGE_LOOKUP = f"""
WITH d AS (SELECT DISTINCT lang FROM documents),
a AS (SELECT lang FROM d UNION ALL SELECT * FROM (VALUES {fx.sql_values([(x,) for x in fx.LANGUAGES])}) v(lang)),
n AS (SELECT * FROM (VALUES ('hi', 'Hindi'), ('bn', 'Bengali'), ('pa', 'Punjabi'), ('gu', 'Gujarati'), ('or', 'Odia'),
      ('ta', 'Tamil'), ('te', 'Telugu'), ('kn', 'Kannada'), ('ml', 'Malayalam'), ('ur', 'Urdu'), ('en', 'English')) v(code, name)),
r AS (SELECT a.lang, coalesce(n.code, 'en') AS code
      FROM a LEFT JOIN n ON lower(trim(a.lang)) = n.code OR lower(trim(a.lang)) = lower(n.name))
SELECT lang, code, name FROM r JOIN n USING (code)
"""

CITATIONS = """
SELECT doc_id, concat_ws(' · ', coalesce(source, 'unknown'),
                         CASE WHEN doc_id % 3 <> 0 THEN 'p.' || CAST(doc_id % 50 AS VARCHAR) END,
                         CASE WHEN doc_id % 5 <> 0 THEN 'score ' || printf('%.3f', n_chars / 8.0::DOUBLE) END) AS label
FROM documents
"""

SCORE_NAMES = """
SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS DOUBLE) END, n_chars / 2.0::DOUBLE) AS score FROM documents
"""

SITE_DOCUMENTS = f"""
WITH p AS (SELECT regexp_extract(url, '^https?://([^/?#]+/[^/?#]*)', 1) AS site, page_id, {html_text('html')} AS page_text
           FROM {PAGES_ALL} AS pages)
SELECT site, CAST(count(*) AS INTEGER) AS page_count,
       string_agg(page_text, chr(10) || chr(10) ORDER BY page_id, page_text) AS document_text
FROM p WHERE page_text <> '' GROUP BY site
"""

# The file's name is one word, so chunk bounds don't depend on it; it is then left out.
_FILE_TEXT = clean(f"'Source File: F | Page Number: ' || CAST(doc_id % 100 + 1 AS VARCHAR) || ' | ' || cleaned")
FILE_BUILD = f"""
WITH d AS (SELECT doc_id, {clean_document('text')} AS cleaned FROM documents),
r AS (SELECT 'txt' AS source_type, CAST(doc_id % 100 + 1 AS INTEGER) AS page_number,
             CASE WHEN cleaned = '' THEN '' ELSE {_FILE_TEXT} END AS t, doc_id AS k FROM d
      UNION ALL
      SELECT 'csv', NULL, 'Source: csv | Condition: ' || c_name || ' | Diet: ' || c_mktsegment || ' | Medical: '
             || CAST(c_acctbal AS VARCHAR) || ' | Source File: F', -c_custkey FROM customer),
{_chunk_words_cte('r', 'source_type, page_number, k', 350, 90)}
SELECT source_type, page_number, chunk_index, regexp_replace(chunk_text, '^Source File: F \\| Page', 'Page') AS chunk_text FROM c
WHERE {_word_count('chunk_text')} >= 10 AND {_alpha_ratio('chunk_text')} >= 0.2 AND NOT {_boiler('chunk_text')}
"""

ORACLE.update({"language_lookup": LANGUAGE_LOOKUP, "citations": CITATIONS, "score_names": SCORE_NAMES,
               "site_documents": SITE_DOCUMENTS, "file_build": FILE_BUILD})


# ---------------------------------------------------------------------------
# The batch of questions, with the default (identity, extractive) models
# ---------------------------------------------------------------------------

_DISCLAIMER = ("This answer is drawn from the indexed texts on traditional practice and is general information only, not "
               "medical advice; please see a qualified practitioner before making health decisions.")
_URGENT = ("Some of the symptoms you describe can be an emergency. Please contact emergency services or a doctor right away; "
           "this assistant cannot help with urgent care.")
_NOTHING = "The indexed sources contain nothing relevant to this question."


def ask_batch_sql() -> str:
    body = retrieve_sql().strip()[len("WITH "):]
    at = body.rindex("\nSELECT o.item_id")
    first = "regexp_replace(trim(string_split(k.chunk_text, '. ')[1]), '\\.+$', '')"
    return f"""
WITH valid AS ({VALIDATE_QUESTIONS.strip()}),
lang AS ({DETECT_LANGUAGE.strip()}),
flag AS ({RED_FLAGS.strip()}),
askq AS (SELECT concat_ws('-', c.conv_id, c.turn) AS item_id, c.text, v.reason, l.lang_code, f.flagged
         FROM {CONV} c JOIN valid v USING (conv_id, turn) JOIN lang l USING (conv_id, turn) JOIN flag f USING (conv_id, turn)),
benchmark AS (SELECT item_id, text FROM askq WHERE reason IS NULL AND NOT flagged),
{body[:at]},
pk AS ({body[at:].strip()}),
src AS (SELECT pk.item_id,
               list(concat_ws('|', k.source_file, CAST(k.page_number AS VARCHAR), k.chunk_text) ORDER BY mmr_rank) AS sources,
               string_agg(CASE WHEN {first} <> '' THEN {first} || '. [' || coalesce(k.source_file, 'unknown') || ', '
                          || coalesce(CAST(k.page_number AS VARCHAR), 'None') || ']' END, ' ' ORDER BY mmr_rank) AS answer
        FROM pk JOIN k USING (chunk_id) GROUP BY pk.item_id)
SELECT a.item_id AS question_id,
       CASE WHEN a.reason IS NOT NULL THEN NULL WHEN a.flagged THEN {_q(_URGENT)}
            ELSE coalesce(nullif(src.answer, ''), {_q(_NOTHING)}) END AS answer,
       CASE WHEN a.reason IS NULL THEN a.lang_code END AS language,
       CASE WHEN a.reason IS NULL THEN a.lang_code END AS detected_language,
       CASE WHEN a.reason IS NULL THEN {_q(_DISCLAIMER)} END AS disclaimer,
       coalesce(src.sources, CAST([] AS VARCHAR[])) AS sources, a.reason
FROM askq a LEFT JOIN src USING (item_id)
"""


ORACLE["ask_batch"] = ask_batch_sql()


# ---------------------------------------------------------------------------
# Planes from md5 signs, 24 tables, about 8 items a bucket, one-bit probes
# ---------------------------------------------------------------------------

_LSH = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nb AS (SELECT count(*) AS n, greatest(1, CAST(floor(log2(count(*) / 8.0) + 0.5) AS INTEGER)) AS bits FROM e),
pl AS (SELECT t, b, list(CASE WHEN substr(md5(t || ',' || b || ',' || p), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
                         ORDER BY p) AS plane
       FROM range(24) t(t), (SELECT unnest(range((SELECT bits FROM nb))) AS b), range(64) p(p) GROUP BY t, b),
bk AS (SELECT vec_id, t, CAST(sum(CASE WHEN list_dot_product(v, plane) > 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS BIGINT) AS b
       FROM e, pl GROUP BY vec_id, t),
pr AS (SELECT vec_id, t, b FROM bk UNION ALL
       SELECT vec_id, t, xor(bk.b, CAST(1 << CAST(f AS INTEGER) AS BIGINT)) AS b FROM bk, (SELECT unnest(range((SELECT bits FROM nb))) AS f)),
pairs AS (SELECT DISTINCT pr.vec_id AS query_vec_id, bk.vec_id FROM pr JOIN bk USING (t, b) WHERE pr.vec_id <> bk.vec_id),
s AS (SELECT query_vec_id, p.vec_id, round(list_cosine_similarity(x.v, y.v), 6) AS score
      FROM pairs p JOIN e x ON x.vec_id = p.query_vec_id JOIN e y ON y.vec_id = p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS rank FROM s),
lsh AS (SELECT query_vec_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5)"""

KNN_LSH = f"WITH {_LSH} SELECT * FROM lsh"
LSH_RECALL = f"""
WITH {_LSH},
exact AS ({KNN_SELF.strip()})
SELECT count(DISTINCT e.query_vec_id) AS n_queries, count(*) AS n_exact,
       sum(CASE WHEN l.vec_id IS NULL THEN 0 ELSE 1 END) / count(*) AS recall,
       (SELECT count(*) FROM pairs) AS pairs_scored,
       round((SELECT count(*) FROM pairs) / ((SELECT n FROM nb) * ((SELECT n FROM nb) - 1)), 6) AS share_of_all_pairs
FROM exact e LEFT JOIN lsh l USING (query_vec_id, vec_id)
"""

ORACLE.update({"knn_lsh": KNN_LSH, "lsh_recall": LSH_RECALL})


# ---------------------------------------------------------------------------
# Pages through the extractor chain, line by line; a file that no extractor reads
# is a row without text
# ---------------------------------------------------------------------------

_EXTRACTED = f"replace(replace({html_lines('html')}, '&copy;', '©'), '&middot;', '·')"
_EXTRACTED_LINES = (f"array_to_string(list_filter(list_transform(string_split({_EXTRACTED}, chr(10)), lambda x: {clean('x')}), "
                    f"lambda x: x <> ''), chr(10))")
EXTRACT_PAGES = f"""
SELECT url AS source_file, CAST(1 AS INTEGER) AS page_number, {_EXTRACTED_LINES} AS page_text, 'html' AS extractor,
       false AS failed
FROM {PAGES_ALL} AS pages
UNION ALL SELECT * FROM (VALUES ('broken.bin', NULL, NULL, NULL, true), ('two pages.txt', 1, 'one', 'text', false),
                                ('two pages.txt', 2, 'two', 'text', false))
"""

ORACLE["extract_pages"] = EXTRACT_PAGES


# ---------------------------------------------------------------------------
# stored indexes, late files, sketches, plug-ins
# ---------------------------------------------------------------------------

def _cell_round(i: int) -> str:
    """Centroids after one more round: integer sums over the vectors nearest to each."""
    return f"""
a{i} AS (SELECT vec_id, v, arg_max(cell, (round(list_cosine_similarity(v, cv), 6), -cell)) AS cell FROM e, c{i} GROUP BY vec_id, v),
s{i} AS (SELECT cell, pos, CAST(sum(CAST(floor(x * 1000000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0::DOUBLE AS x
         FROM (SELECT cell, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS x FROM a{i}) GROUP BY cell, pos),
m{i} AS (SELECT cell, list(x ORDER BY pos) AS cv FROM s{i} GROUP BY cell),
c{i + 1} AS (SELECT c{i}.cell, coalesce(m{i}.cv, c{i}.cv) AS cv FROM c{i} LEFT JOIN m{i} USING (cell))"""


KNN_CELLS = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT greatest(1, least(4096, CAST(floor(2 * sqrt(count(*)) + 0.5) AS BIGINT))) AS cells FROM e),
c0 AS (SELECT cell, v AS cv FROM (SELECT v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell FROM e), n
       WHERE cell < cells),
{_cell_round(0)},
{_cell_round(1)},
p AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, cv), 6) DESC, cell) AS place
      FROM e, c2),
s AS (SELECT q.vec_id AS query_vec_id, i.vec_id, round(list_cosine_similarity(x.v, y.v), 6) AS score
      FROM (SELECT vec_id, cell FROM p, n WHERE place <= CAST(floor(0.4 * cells) AS BIGINT)) q
      JOIN (SELECT vec_id, cell FROM p WHERE place = 1) i ON q.cell = i.cell AND q.vec_id <> i.vec_id
      JOIN e x ON x.vec_id = q.vec_id JOIN e y ON y.vec_id = i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_vec_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""

BM25_FILTERED = "WITH " + bm25_ctes(RETRIEVAL_K).replace("chunk_id", "doc_id").replace("chunk_text", "text").replace(
    "FROM k)", "FROM documents)").replace(
    "CROSS JOIN st GROUP BY ALL),\nkw", "CROSS JOIN st JOIN documents d ON d.doc_id = post.doc_id "
    "WHERE d.lang = CASE WHEN item_id % 2 = 0 THEN 'fr' ELSE 'de' END GROUP BY ALL),\nkw") + """
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM kw
"""

_SOURCE = f"""
b AS (SELECT doc_id, {clean('text')} AS t FROM documents),
{_chunk_words_cte('b', 'doc_id', 350, 90, 'o')},
{_chunk_words_cte('b', 'doc_id', 400, 100, 'n')},
src AS (SELECT doc_id, chunk_index, chunk_text FROM oc WHERE doc_id % 50 > 1
        UNION ALL SELECT doc_id, chunk_index, chunk_text FROM nc WHERE doc_id % 50 = 1)"""

INDEX_REFRESH = f"""
WITH {_SOURCE}
SELECT doc_id, chunk_index, chunk_text FROM src
"""

INDEX_CHANGE_LOG = f"""
WITH {_SOURCE}
SELECT 1 AS version, coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.chunk_index, o.chunk_index) AS chunk_index,
       CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS op
FROM src n FULL OUTER JOIN oc o ON n.doc_id = o.doc_id AND n.chunk_index = o.chunk_index
WHERE n.chunk_text IS DISTINCT FROM o.chunk_text
"""

LENGTH_REPORT = f"""
WITH k AS ({BUILD_CHUNKS})
SELECT source_file, count(*) AS n_rows, max(length(chunk_text)) AS max_len, min(length(chunk_text)) AS min_len,
       avg(length(chunk_text)) AS avg_len, quantile_disc(length(chunk_text), 0.5) AS median_len
FROM k GROUP BY source_file
"""

LENGTH_REPORT_SQL = f"""
WITH k AS ({BUILD_CHUNKS})
SELECT CAST(max(length(chunk_text)) AS INTEGER) AS max_len, CAST(min(length(chunk_text)) AS INTEGER) AS min_len,
       avg(length(chunk_text)) AS avg_len FROM k
"""


def ask_plugins_sql() -> str:
    """ask_batch with the marking translator and the hashing generator."""
    sql = ask_batch_sql().strip()
    english = "CASE WHEN l.lang_code <> 'en' THEN c.text || ' ?' ELSE c.text END AS text"
    sql = sql.replace("c.text, v.reason, l.lang_code, f.flagged", f"{english}, v.reason, l.lang_code, f.flagged OR c.text = 'سلام' AS flagged")
    at = sql.index("src AS (SELECT pk.item_id")
    return sql[:at] + f"""src AS (SELECT pk.item_id, count(*) AS n_sources,
               string_agg('[Source: ' || coalesce(k.source_file, 'unknown') || ', Page: '
                          || coalesce(CAST(k.page_number AS VARCHAR), 'None') || '] ' || k.chunk_text,
                          chr(10) || chr(10) ORDER BY mmr_rank) AS block
        FROM pk JOIN k USING (chunk_id) GROUP BY pk.item_id)
SELECT a.item_id AS question_id,
       CASE WHEN a.reason IS NULL THEN CASE WHEN a.lang_code <> 'en' THEN '[' || a.lang_name || '] ' ELSE '' END ||
            CASE WHEN a.flagged THEN {_q(_URGENT)} WHEN src.block IS NULL THEN {_q(_NOTHING)}
                 ELSE sha256('Context:' || chr(10) || src.block || chr(10) || chr(10) || 'Question: ' || a.text || chr(10) || chr(10)
                             || {_q(PROMPT_TAIL)}) END END AS answer,
       CASE WHEN a.reason IS NULL THEN a.lang_code END AS language,
       CAST(coalesce(src.n_sources, 0) AS INTEGER) AS n_sources, a.reason
FROM (SELECT askq.*, lang.lang_name FROM askq JOIN lang ON concat_ws('-', lang.conv_id, lang.turn) = askq.item_id) a
LEFT JOIN src USING (item_id)
"""


ORACLE.update({
    "knn_cells": KNN_CELLS, "bm25_postings": BM25, "bm25_filtered": BM25_FILTERED, "index_refresh": INDEX_REFRESH, "index_change_log": INDEX_CHANGE_LOG,
    "stream_late": STREAM_SYNC, "length_report": LENGTH_REPORT, "length_report_sql": LENGTH_REPORT_SQL,
    "ask_plugins": ask_plugins_sql(),
})


# ---------------------------------------------------------------------------
# stored tables
# ---------------------------------------------------------------------------

HIT_PASSAGES = f"""
WITH {_chunks_cte()},
{bm25_ctes(RETRIEVAL_K)}
SELECT kw.item_id, kw.chunk_id, CAST(kw.rank AS INTEGER) AS rank, k.chunk_text, k.source_file
FROM kw JOIN k USING (chunk_id)
"""

TEXT_PAGES = """
SELECT doc_id // 100 AS file, CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS INTEGER) AS page_number,
       coalesce(text, '') AS page_text, false AS failed
FROM documents
"""

STORED_TABLES = f"""
SELECT chunk_id, chunk_index, coalesce(source_file, 'none') || '.PDF' AS source_file, 'pdf' AS source_type
FROM ({BUILD_CHUNKS.strip()})
UNION ALL
SELECT chunk_id, chunk_index, source_file, source_type FROM ({STAGING_TO_PROCESSED.strip()})
"""

ORACLE.update({"hit_passages": HIT_PASSAGES, "text_pages": TEXT_PAGES, "stored_tables": STORED_TABLES})
