"""SQL parts shared by the checks: the same tables, written for the checking engine."""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def fold(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss')"


DOCS = """docs AS (
  SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS document_id,
         'doc-' || doc_id || '.txt' AS document_name, text, lang, n_chars, doc_id
  FROM documents)"""

LINES = f"""lines AS (
  SELECT project_id, document_id, document_name,
         list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
                        lambda x: rtrim(x, {WS})) AS ls
  FROM docs WHERE regexp_matches(text, '[^\\s]'))"""

SECTIONS = f"""sections AS (
  SELECT project_id, document_id, document_name,
         trim(array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)), {WS}) AS text, ls
  FROM lines)"""


def chunks(size: int = 800, overlap: int = 120) -> str:
    step = size - overlap
    return f"""worded AS (
  SELECT project_id, document_id, document_name,
         list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w,
         list_min(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] <> '' THEN i END), lambda x: x IS NOT NULL)) AS line_start,
         list_max(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] <> '' THEN i END), lambda x: x IS NOT NULL)) AS line_end
  FROM sections),
windows AS (
  SELECT *, unnest(range(CASE WHEN len(w) <= {size} THEN 1
                         ELSE CAST(ceil((len(w) - {size}) / CAST({step} AS DOUBLE)) AS BIGINT) + 1 END)) AS i
  FROM worded),
chunks AS (
  SELECT project_id, document_id, document_name, CAST(i AS INTEGER) AS chunk_index,
         document_id || ':1:' || i AS chunk_id,
         array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text,
         CAST(least({size}, len(w) - i * {step}) AS INTEGER) AS token_count,
         line_start, line_end
  FROM windows)"""


CHUNKS = ",\n".join([DOCS, LINES, SECTIONS, chunks()])

QUERIES = """queries AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, 'src' || (item_id % 20) AS project_id,
         text AS query, item_id
  FROM benchmark)"""

ORDER = "document_name, chunk_index, document_id, chunk_id"


def terms(source: str, key: str, text: str, out: str) -> str:
    """Identifier and term tables of a text column, in the form that needs no look-around:
    runs of words and separators; a run counts when a separator follows its first word."""
    sep = "[._/:+-]"
    return f"""{out}_runs AS (
  SELECT {key}, unnest(rs) AS run, generate_subscripts(rs, 1) AS pos
  FROM (SELECT {key}, regexp_extract_all({fold(text)}, '[a-z0-9._/:+-]+') AS rs FROM {source})),
{out}_sep AS (
  SELECT {key}, pos, regexp_replace(regexp_replace(run, '^{sep}+', ''), '{sep}+$', '') AS token
  FROM {out}_runs
  WHERE regexp_matches(run, '^{sep}*[a-z0-9]+{sep}')
    AND length(regexp_replace(regexp_replace(run, '^{sep}+', ''), '{sep}+$', '')) >= 2),
{out}_rest AS (
  SELECT {key}, pos, run FROM {out}_runs
  WHERE NOT regexp_matches(run, '^{sep}*[a-z0-9]+{sep}')
     OR length(regexp_replace(regexp_replace(run, '^{sep}+', ''), '{sep}+$', '')) < 2),
{out}_idents AS (
  SELECT {key}, pos AS gid, token AS surface, 'w' AS kind FROM {out}_sep
  UNION ALL
  SELECT {key}, pos, regexp_replace(token, '[._/:\\s-]+', '.', 'g'), 'w' FROM {out}_sep
  UNION ALL
  SELECT {key}, pos * 100000 + nth, word, 'w' FROM (
    SELECT {key}, pos, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth
    FROM (SELECT {key}, pos, regexp_extract_all(run, '[a-z0-9]+') AS ws FROM {out}_rest))
  WHERE length(word) >= 4 AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[0-9]')
  UNION ALL
  SELECT {key}, first, word, 'd' FROM (
    SELECT s.{key}, f.first, unnest(regexp_extract_all(s.token, '[a-z0-9]+')) AS word
    FROM {out}_sep s JOIN (
      SELECT {key}, surface, min(pos) AS first FROM (
        SELECT {key}, pos, token AS surface FROM {out}_sep
        UNION ALL SELECT {key}, pos, regexp_replace(token, '[._/:\\s-]+', '.', 'g') FROM {out}_sep)
      GROUP BY ALL) f ON f.{key} = s.{key} AND f.surface = s.token)
  WHERE length(word) >= 4 AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[0-9]')),
{out}_ascii AS (
  SELECT {key}, word FROM (
    SELECT {key}, unnest(regexp_extract_all({fold(text)}, '[a-z0-9]+')) AS word FROM {source}) x
  WHERE length(word) >= 2
    AND NOT EXISTS (SELECT 1 FROM {out}_idents i WHERE i.{key} = x.{key} AND i.surface = x.word)),
{out}_cjk AS (
  SELECT {key}, unnest(list_distinct(list_concat(rs, flatten(list_transform(rs,
           lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))) AS term
  FROM (SELECT {key}, regexp_extract_all({text}, '[一-鿿]+') AS rs FROM {source}))"""


def grams(column: str) -> str:
    return f"list_distinct(list_transform(range(1, length({column}) - 1), lambda i: substring({column}, i, 3)))"


def _changes(outer: str, inner: str) -> str:
    return (
        f"(regexp_matches({outer}, '^[._/:+-]$')"
        f" OR regexp_matches({inner}, '^[a-z]$') <> regexp_matches({outer}, '^[a-z]$')"
        f" OR regexp_matches({inner}, '^[0-9]$') <> regexp_matches({outer}, '^[0-9]$'))"
    )


PAIRS = f"""vocabulary AS (
  SELECT DISTINCT c.project_id, i.surface FROM chunk_idents i JOIN chunks c USING (chunk_id)
  WHERE length(i.surface) >= 5),
pairs AS (
  SELECT DISTINCT q.project_id, qi.surface AS mine, v.surface AS theirs,
         CASE WHEN length(qi.surface) <= length(v.surface) THEN qi.surface ELSE v.surface END AS s,
         CASE WHEN length(qi.surface) <= length(v.surface) THEN v.surface ELSE qi.surface END AS l
  FROM query_idents qi JOIN queries q USING (query_id)
  JOIN vocabulary v ON v.project_id = q.project_id
  WHERE length(qi.surface) >= 5 AND qi.surface <> v.surface),
placed AS (SELECT *, strpos(l, s) AS place FROM pairs),
judged AS (
  SELECT project_id, mine, theirs,
         place > 0 AND length(s) / CAST(length(l) AS DOUBLE) >= 0.4 AND CASE
           WHEN place = 1 AND length(s) = length(l) THEN true
           WHEN place = 1 THEN {_changes("substring(l, place + length(s), 1)", "substring(s, length(s), 1)")}
           WHEN place + length(s) = length(l) + 1 THEN true
           ELSE {_changes("substring(l, place - 1, 1)", "substring(s, 1, 1)")}
            AND {_changes("substring(l, place + length(s), 1)", "substring(s, length(s), 1)")} END AS contained,
         place = 0
           AND NOT (regexp_extract(s, '([0-9]+)$', 1) <> '' AND regexp_extract(l, '([0-9]+)$', 1) <> ''
                    AND regexp_extract(s, '([0-9]+)$', 1) <> regexp_extract(l, '([0-9]+)$', 1))
           AND len(list_intersect({grams("s")}, {grams("l")}))
               / CAST(least(len({grams("s")}), len({grams("l")})) AS DOUBLE) >= 0.5 AS similar
  FROM placed)"""

HITS = """hits AS (
  SELECT qi.query_id, qi.gid, ci.chunk_id,
         max(CASE WHEN qi.kind = 'w' AND ci.kind = 'w' AND qi.surface = ci.surface THEN 5
                  WHEN qi.kind = 'w' AND ci.kind = 'w' AND j.contained THEN 3
                  WHEN j.similar THEN 2 ELSE 0 END) AS tier
  FROM query_idents qi JOIN queries q USING (query_id)
  JOIN chunks c ON c.project_id = q.project_id
  JOIN chunk_idents ci ON ci.chunk_id = c.chunk_id
  LEFT JOIN judged j ON j.project_id = q.project_id AND j.mine = qi.surface AND j.theirs = ci.surface
  GROUP BY ALL HAVING tier > 0),
strong AS (SELECT query_id, gid, max(tier) AS best FROM hits GROUP BY ALL),
kept AS (SELECT h.* FROM hits h JOIN strong s USING (query_id, gid) WHERE h.tier > 2 OR s.best <= 2),
by_identifier AS (
  SELECT query_id, chunk_id, count(*) FILTER (tier = 5) AS e, count(*) FILTER (tier = 3) AS c,
         count(*) FILTER (tier = 2) AS n
  FROM kept GROUP BY ALL),
by_term AS (
  SELECT query_id, chunk_id, count(*) FILTER (kind = 'a') AS a, count(*) FILTER (kind = 'c') AS j FROM (
    SELECT qa.query_id, ca.chunk_id, 'a' AS kind
    FROM query_ascii qa JOIN queries q USING (query_id)
    JOIN chunks c ON c.project_id = q.project_id
    JOIN (SELECT DISTINCT * FROM chunk_ascii) ca ON ca.chunk_id = c.chunk_id AND ca.word = qa.word
    UNION ALL
    SELECT qc.query_id, cc.chunk_id, 'c'
    FROM query_cjk qc JOIN queries q USING (query_id)
    JOIN chunks c ON c.project_id = q.project_id
    JOIN chunk_cjk cc ON cc.chunk_id = c.chunk_id AND cc.term = qc.term) GROUP BY query_id, chunk_id),
keyword_scores AS (
  SELECT query_id, c.project_id, c.document_id, c.document_name, c.chunk_index, chunk_id,
         CAST(coalesce(e, 0) AS INTEGER) AS exact_identifiers,
         CAST(coalesce(a, 0) AS INTEGER) AS exact_ascii_terms,
         CAST(coalesce(j, 0) AS INTEGER) AS exact_cjk_terms,
         CAST(coalesce(b.c, 0) AS INTEGER) AS contained_identifiers,
         CAST(coalesce(n, 0) AS INTEGER) AS ngram_matches,
         CAST(5 * coalesce(e, 0) + 3 * coalesce(b.c, 0) + 2 * coalesce(n, 0)
              + least(coalesce(a, 0) + coalesce(j, 0), 4) AS DOUBLE) AS keyword_score
  FROM by_identifier b FULL JOIN by_term t USING (query_id, chunk_id) JOIN chunks c USING (chunk_id)),
keyword_ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC,
         document_name, chunk_index, document_id, chunk_id) AS INTEGER) AS rank
  FROM keyword_scores)"""

KEYWORD = ",\n".join(
    [CHUNKS, QUERIES, terms("chunks", "chunk_id", "text", "chunk"),
     terms("queries", "query_id", "query", "query"), PAIRS, HITS]
)

VECTOR = """vector_scores AS (
  SELECT q.query_id, c.project_id, c.document_id, c.document_name, c.chunk_index, c.chunk_id,
         list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(qe.embedding AS DOUBLE[])) AS vector_score
  FROM queries q JOIN embeddings qe ON qe.vec_id = q.item_id
  JOIN chunks c ON c.project_id = q.project_id AND (CAST(c.document_id AS BIGINT) + 3 * c.chunk_index) % 11 <> 0
  JOIN embeddings e ON e.vec_id = (CAST(c.document_id AS BIGINT) + 7 * c.chunk_index) % (SELECT count(*) FROM embeddings)),
vector_ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC,
         document_name, chunk_index, document_id, chunk_id) AS INTEGER) AS rank
  FROM vector_scores WHERE vector_score >= 0)"""


def fused(pool: int, vw: float = 0.65, kw: float = 0.35, k: int = 60) -> str:
    return f"""merged AS (
  SELECT query_id, project_id, document_id, document_name, chunk_index, chunk_id, vector_score,
         keyword_score, coalesce(exact_identifiers, 0) AS exact_identifiers,
         coalesce(contained_identifiers, 0) AS contained_identifiers,
         coalesce(ngram_matches, 0) AS ngram_matches,
         coalesce(exact_ascii_terms, 0) AS exact_ascii_terms
  FROM (SELECT * FROM vector_ranked WHERE rank <= {pool}) v
  FULL JOIN (SELECT * FROM keyword_ranked WHERE rank <= {pool}) w
  USING (query_id, project_id, document_id, document_name, chunk_index, chunk_id)),
routed AS (
  SELECT *, CASE WHEN vector_score IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY vector_score DESC NULLS LAST) END AS vector_rank,
         CASE WHEN keyword_score IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY keyword_score DESC NULLS LAST) END AS keyword_rank
  FROM merged),
shares AS (
  SELECT *, CASE WHEN vector_rank > 0 THEN CAST({vw} AS DOUBLE) * {k + 1} / ({k} + vector_rank) ELSE CAST(0 AS DOUBLE) END AS vector_rrf_score,
         CASE WHEN keyword_rank > 0 THEN CAST({kw} AS DOUBLE) * {k + 1} / ({k} + keyword_rank) ELSE CAST(0 AS DOUBLE) END AS keyword_rrf_score
  FROM routed),
fused AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector_rrf_score + keyword_rrf_score DESC,
         document_name, chunk_index, document_id, chunk_id) AS INTEGER) AS rank,
         vector_rrf_score + keyword_rrf_score AS fused_score
  FROM shares)"""
