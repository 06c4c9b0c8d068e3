"""DuckDB SQL for the rows of those queries that SQL can express."""

from quire.llm import licenses

OP1 = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM base),
g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
tri AS (SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM g),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM base),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT base.r, doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM base JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words OR n_dup_lines >= 3
        OR word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words AS strict_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT sum(k) / sum(n) AS mean, var_samp(k / n) AS var, avg(1 / n) AS inv FROM h),
pr AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND var > mean * (1 - mean) * inv AND var < mean * (1 - mean)
         THEN (mean * (1 - mean) - var) / (var - mean * (1 - mean) * inv) ELSE 10.0 END AS weight FROM mo),
v AS (SELECT source, (k + mean * weight) / (n + weight) > 0.5 AS host_bad FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(host_bad, false) AND strict_failed) AS kept,
       coalesce(host_bad, false) AS host_bad
FROM f LEFT JOIN v USING (source)
"""

OP2 = r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id,
        [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sh AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s
       FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM sh GROUP BY ALL),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM sh a JOIN sh b USING (s) WHERE a.r <> b.r GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM w JOIN reach ON reach.a = w.r JOIN w t ON t.r = reach.b LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""

# words of op8
_W8 = r"[x FOR x IN regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
      r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W8.format(t='text')} AS w FROM documents),
it AS (SELECT item_id, {_W8.format(t='text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM it WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, win.n, item_id FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.KNOWN.items()))


def _canonical(text: str) -> str:
    t = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    t = rf"regexp_replace({t}, '(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
    for old, new in (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
                     ("organisation", "organization"), ("favour", "favor"), ("fulfil ", "fulfill "),
                     ("per cent", "percent"), ("http://", "https://")):
        t = f"replace({t}, '{old}', '{new}')"
    return rf"trim(regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"


OP9 = f"""
WITH known AS (SELECT sha256({_canonical('t')}) AS digest, min(id) AS license_id
               FROM (VALUES {_KNOWN}) v(id, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical('text')}) AS digest FROM documents),
l AS (SELECT r, sha256({_canonical('u')}) AS digest
      FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS u FROM d)),
m AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
      FROM l JOIN known USING (digest) GROUP BY r)
SELECT doc_id, digest, license_id, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM d LEFT JOIN known USING (digest) LEFT JOIN m USING (r)
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM rep)),
word AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN cov USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM cov GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM s),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT b, item_id, t, count(*)::BIGINT AS times FROM (
        SELECT row_number() OVER () AS b, item_id,
          unnest([x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']) AS t FROM benchmark) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t, big_n),
m AS (SELECT r, doc_id, 100 - 75 + (75 * n * big_n) // big_l AS m FROM s, c),
sc AS (SELECT b, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score,
        row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""

ORACLE = {"op1_host_quality": OP1, "op2_ngram_jaccard": OP2, "op8_decontaminate": OP8, "op9_license_scan": OP9,
          "op10_remove_repeats": OP10, "op11_ranked_search": OP11}
