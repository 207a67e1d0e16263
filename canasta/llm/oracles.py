"""SQL with the same result as those queries that SQL can express; for unique document ids."""

from canasta.llm.urls import ORDER, RULES

OP8 = r"""
WITH words AS (
  SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS list FROM documents)),
windows AS (
  SELECT doc_id, i, word, count(*) OVER ahead AS n, md5(string_agg(word, ' ') OVER ahead) AS hash
  FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT hash, min(doc_id) AS first_doc FROM windows WHERE n = 50 GROUP BY hash),
told AS (
  SELECT doc_id, i, word, max(CASE WHEN n = 50 AND first_doc < doc_id THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN firsts USING (hash)
  UNION ALL SELECT doc_id, 0, NULL, 2 FROM documents)
SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone = 1) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM told GROUP BY doc_id"""

OP5 = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),
pieces AS (
  SELECT doc_id, n, k, substring(hex, 256 * k + 1, 454) AS piece
  FROM (SELECT doc_id, hex, length(hex) // 2 AS n, unnest(range((length(hex) // 2 + 127) // 128)) AS k
        FROM bytes)),
places AS (SELECT doc_id, n, k, piece, unnest(range(least(128, n - 128 * k))) AS j FROM pieces),
windows AS (
  SELECT doc_id, 128 * k + j AS i, substring(piece, 2 * j + 1, 2) AS byte,
         CASE WHEN 128 * k + j + 100 <= n THEN md5(substring(piece, 2 * j + 1, 200)) END AS hash
  FROM places),
firsts AS (
  SELECT hash, min(doc_id) AS first_doc, arg_min(i, (doc_id, i)) AS first_i
  FROM windows WHERE hash IS NOT NULL GROUP BY hash),
told AS (
  SELECT doc_id, i, byte, max(CASE WHEN first_doc < doc_id OR first_i < i THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN firsts USING (hash)),
runs AS (
  SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0
            THEN 1 ELSE 0 END AS begins
  FROM told
  UNION ALL SELECT doc_id, -1, NULL, 2, 0 FROM documents)
SELECT doc_id, count(byte) AS n_bytes, count(*) FILTER (gone = 1) AS n_removed,
       CAST(sum(begins) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256
FROM runs GROUP BY doc_id"""


_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
        FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(length(hex) // 2), lambda i:
             16 * (strpos('0123456789ABCDEF', substring(hex, 2 * i + 1, 1)) - 1)
             + strpos('0123456789ABCDEF', substring(hex, 2 * i + 2, 1)) - 1)),
           lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h
  FROM bytes, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0
               THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
               ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
skips AS (
  SELECT word, n, substring(word, 1, i) || chr(1) || substring(word, i + 2) AS hole,
         substring(word, 1, i) || substring(word, i + 2) AS less
  FROM words, unnest(range(length(word))) AS place(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b USING (hole) WHERE a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON s.less = w.word
  UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON s.less = w.word),
best AS (
  SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place
  FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
chains AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c USING (word) JOIN forms e ON e.word = c.root AND e.form IS NULL"""

_SPANS = "(VALUES (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2), (4, 3, 2), (4, 1, 3), (4, 2, 3)) AS span(size, place, m)"

OP12 = rf"""
WITH pieces AS (
  SELECT doc_id, lang, generate_subscripts(list, 1) AS piece, unnest(list) AS body
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(
          translate(coalesce(text, ''), {_FOLD}), '[.,;:!?\x0A-\x0D]') AS list FROM documents)),
words AS (
  SELECT doc_id, lang, piece, generate_subscripts(list, 1) AS i, unnest(list) AS w1
  FROM (SELECT *, regexp_extract_all(body, '[^\x20\x09]+') AS list FROM pieces)),
rows AS (
  SELECT lang, w1, lead(w1, 1) OVER ahead AS w2, lead(w1, 2) OVER ahead AS w3, lead(w1, 3) OVER ahead AS w4
  FROM words WINDOW ahead AS (PARTITION BY doc_id, piece ORDER BY i)),
phrases AS (
  SELECT lang, 1 AS size, w1 AS phrase FROM rows
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM rows WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM rows WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM rows WHERE w4 IS NOT NULL),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT *, string_split(phrase, ' ') AS list FROM counts WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, k,
         CAST((CAST(2000000 AS HUGEINT) * c.f) // (x.f + y.f) AS BIGINT) AS score
  FROM candidates c JOIN (VALUES (1), (2), (3)) AS cut(k) ON k < c.size
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.list[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.list[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT c.lang, s.phrase
  FROM candidates c JOIN {_SPANS} USING (size)
  JOIN candidates s ON s.lang = c.lang AND s.phrase = array_to_string(c.list[place:place + m - 1], ' ')
  WHERE CAST(100 AS HUGEINT) * c.f >= CAST(80 AS HUGEINT) * s.f),
kept AS (SELECT * FROM lowest ANTI JOIN gone USING (lang, phrase)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000"""


def _url_models() -> str:
    """One set of tables per order: counts, contexts and mixed probabilities."""
    parts = []
    for k in range(ORDER + 1):
        own = "counts" if k == ORDER else (
            f"(SELECT right(gram, {k + 1}) AS gram, sum(good) AS good, sum(bad) AS bad FROM counts GROUP BY 1)"
        )
        lower = f"JOIN low{k - 1} p ON p.gram = right(o.gram, {k})" if k else ""
        good, bad = ("p.good", "p.bad") if k else ("1.0::DOUBLE / (kinds + 1)",) * 2
        parts.append(f"""
own{k} AS (SELECT *, left(gram, {k}) AS context FROM {own}),
ctx{k} AS (
  SELECT context, sum(good) AS good_all, sum(bad) AS bad_all, count(*) FILTER (good > 0) AS good_kinds,
         count(*) FILTER (bad > 0) AS bad_kinds, count(*) AS kinds
  FROM own{k} GROUP BY context),
low{k} AS (
  SELECT o.gram,
         CASE WHEN good_all > 0 THEN (o.good::DOUBLE + good_kinds * {good}) / (good_all + good_kinds)::DOUBLE ELSE {good} END AS good,
         CASE WHEN bad_all > 0 THEN (o.bad::DOUBLE + bad_kinds * {bad}) / (bad_all + bad_kinds)::DOUBLE ELSE {bad} END AS bad
  FROM own{k} o JOIN ctx{k} USING (context) {lower})""")
    return ",".join(parts)


def _url_rules(value) -> str:
    cases = [
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value(verdict, host, path)}'"
        for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    return f"CASE {' '.join(cases)} END"


OP13 = rf"""
WITH rests AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_FOLD}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS body
  FROM rests),
ruled AS (
  SELECT *, {_url_rules(lambda verdict, host, path: host + path)} AS rule,
         {_url_rules(lambda verdict, host, path: verdict)} AS told
  FROM parts),
texts AS (
  SELECT body, coalesce(bool_or(told = 'allow'), false) AS good, coalesce(bool_or(told = 'block'), false) AS bad,
         substring(md5(body), 1, 1) IN ('0', '1', '2') AS held_out
  FROM ruled GROUP BY body),
grams AS (
  SELECT body, good AND NOT held_out AS good, bad AND NOT held_out AS bad,
         substring(repeat(chr(2), {ORDER}) || body || chr(3), i, {ORDER + 1}) AS gram
  FROM texts, unnest(range(1, length(body) + 2)) AS place(i)),
counts AS (
  SELECT gram, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM grams GROUP BY gram),
{_url_models()},
scores AS (SELECT gram, CAST(round(1e6 * ln(good / bad)) AS BIGINT) AS score FROM low{ORDER}),
steps AS (
  SELECT body, greatest(-2000, least(2000, CAST(floor(CAST(sum(score) AS BIGINT) / (count(*) * 10000)) AS BIGINT))) AS step
  FROM grams JOIN scores USING (gram) GROUP BY body),
labelled AS (SELECT good, bad, step FROM texts JOIN steps USING (body) WHERE held_out AND (good OR bad)),
sums AS (SELECT count(*) FILTER (good) AS goods, count(*) FILTER (bad) AS bads FROM labelled),
tries AS (SELECT step AS t FROM labelled UNION SELECT 0),
rated AS (
  SELECT t, count(*) FILTER (good AND step < t) / any_value(goods) + count(*) FILTER (bad AND step >= t) / any_value(bads) AS error
  FROM tries, labelled, sums WHERE goods > 0 AND bads > 0 GROUP BY t),
limits AS (SELECT coalesce((SELECT t FROM rated ORDER BY error, abs(t), t LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule,
       CASE WHEN told IS NOT NULL THEN told WHEN step >= t THEN 'allow' ELSE 'block' END AS verdict
FROM ruled JOIN steps USING (body), limits"""
