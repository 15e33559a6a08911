r"""DuckDB SQL for the rows of the queries that SQL can express.

None for op1 (a trained model), op2 and op9 (hashes that SQL lacks decide who goes where), op4 (a tokenizer), op6
and op8 (their verdicts and added spans rest on Java patterns) and the pipeline. README says which of these tests hold against plain Python.
"""

from __future__ import annotations

from tidewatch.llm.path_templates import BAD_NAMES, RULES, TreeSettings

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str) -> str:
    return f"regexp_extract_all({_LOWER}, '{pattern}')"


def _windows(words: str, size: int) -> str:
    """Windows of words as texts; all words as one where they are fewer; none without words."""
    return (
        f"CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(range(greatest(len({words}) - {size}, 0) + 1), "
        f"lambda i: array_to_string({words}[i + 1:i + {size}], ' ')) END"
    )


CONTAMINATION = rf"""WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, unnest({_windows('w', 10)}) AS win FROM items
),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
places AS (
  SELECT doc_id, size, unnest(range(len(w) - size + 1)) AS p, w FROM docs, sizes WHERE len(w) >= size
),
hits AS (
  SELECT doc_id, p, places.size, item
  FROM places JOIN windows ON windows.size = places.size AND win = array_to_string(w[p + 1:p + places.size], ' ')
),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

CONVERSATIONS = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|'))
           + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE docs AS (
  SELECT doc_id, list_distinct({_windows('w', 4)}) AS s
  FROM (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents)
),
sets AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM docs),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sets AS a JOIN sets AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach AS r JOIN links AS l ON l.u = r.v
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM docs LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON u = doc_id"""

ARCHIVE = """WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
stored AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM payloads),
told AS (SELECT *, payload_bytes >= 1000 AND page_id <> last AS again FROM stored)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM told"""

RANKED = rf"""WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row, {_words(r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')} AS w FROM documents
),
sums AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w)) AS n_words FROM docs),
counts AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY row, term
),
weights AS (
  SELECT term, floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM counts, sums GROUP BY term
),
items AS (
  SELECT DISTINCT item_id, unnest({_words(r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')}) AS term FROM benchmark
),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term), sums GROUP BY item_id, row
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
         (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 50"""


def _alike(limit: float) -> str:
    """Chi-square of two branches over good, bad and unlabelled pages; terms as in the operator."""
    terms = []
    for here, there in (("good", "b_good"), ("bad", "b_bad"), ("(n - good - bad)", "(b_n - b_good - b_bad)")):
        for part, size in ((here, "n"), (there, "b_n")):
            expected = f"(({here} + {there})::DOUBLE * {size} / (n + b_n))"
            terms.append(f"CASE WHEN {here} + {there} > 0 THEN ({part} - {expected}) * ({part} - {expected}) / {expected} ELSE 0.0 END")
    return f"({' + '.join(terms)}) < {limit}"


def _templates() -> str:
    """Every level of the tree as one group of CTEs; the SQL has the operator's settings."""
    x = TreeSettings()
    at = "strpos(url, '://')"
    last = f"array_to_string(s[{x.max_depth}:], '/')"
    shaped = (
        "list_transform(string_split(substr(path, 2), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-f]{8,}(-[0-9a-f]{4,})*$') "
        "AND regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '^[0-9]+$') AND regexp_matches(s, '^[a-f-]*[0-9]') "
        "THEN '{h}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END)")
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits) + " END"
    names = ", ".join(f"'{n}'" for n in BAD_NAMES)
    ctes = [f"""rests AS MATERIALIZED (
  SELECT page_id, CASE WHEN {at} > 0 THEN substr(url, {at} + 3) ELSE '' END AS rest FROM pages
),
parts AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
),
slim AS MATERIALIZED (
  SELECT page_id, host, path, rule, ruled, CASE WHEN path = '' THEN []::VARCHAR[] WHEN len(s) <= {x.max_depth} THEN s
         ELSE list_append(s[:{x.max_depth - 1}], {last}) END AS segments,
         coalesce(ruled = 'block', CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{names}]) THEN true END) AS is_bad
  FROM (SELECT *, {rule} AS rule, {ruled} AS ruled, {shaped} AS s FROM parts)
),
level0 AS MATERIALIZED (
  SELECT host, segments, count(*) AS n, count(*) FILTER (WHERE NOT is_bad) AS good, count(*) FILTER (WHERE is_bad) AS bad, '' AS node
  FROM slim WHERE host <> '' GROUP BY host, segments
)"""]
    for k in range(x.max_depth):
        ctes.append(f"""branches{k} AS MATERIALIZED (
  SELECT host, node, segments[{k + 1}] AS segment, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad,
         sum(sum(n)) OVER (PARTITION BY host, node) AS total
  FROM level{k} WHERE len(segments) > {k} GROUP BY host, node, segments[{k + 1}]
),
lagged{k} AS (
  SELECT *, lag(n) OVER w AS b_n, lag(good) OVER w AS b_good, lag(bad) OVER w AS b_bad FROM branches{k}
  WHERE n >= {x.min_pages} AND n >= {x.min_share} * total
  WINDOW w AS (PARTITION BY host, node ORDER BY bad / n, good / n, segment)
),
runs{k} AS (
  SELECT *, sum(CASE WHEN b_n IS NOT NULL AND {_alike(x.alike)} THEN 0 ELSE 1 END)
              OVER (PARTITION BY host, node ORDER BY bad / n, good / n, segment ROWS UNBOUNDED PRECEDING) AS run
  FROM lagged{k}
),
named{k} AS (
  SELECT host, node, unnest(list(segment)) AS segment,
         CASE WHEN count(*) = 1 THEN min(segment) ELSE '(' || string_agg(segment, '|' ORDER BY segment) || ')' END AS branch
  FROM runs{k} GROUP BY host, node, run
),
level{k + 1} AS MATERIALIZED (
  SELECT l.host, l.segments, l.n, l.good, l.bad,
         CASE WHEN len(l.segments) > {k} THEN l.node || '/' || coalesce(branch, '*') ELSE l.node END AS node
  FROM level{k} AS l LEFT JOIN named{k} AS m ON l.host = m.host AND l.node = m.node AND m.segment = l.segments[{k + 1}]
)""")
    ctes.append(f"""judged AS (
  SELECT host, segments, node,
         (sum(good) OVER w + {x.good}) / (sum(good) OVER w + sum(bad) OVER w + {x.good + x.bad}) < {x.min_purity} AS rejected
  FROM level{x.max_depth} WINDOW w AS (PARTITION BY host, node)
)""")
    return "WITH " + ",\n".join(ctes) + """
SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, node AS template
FROM slim AS s LEFT JOIN judged AS j ON s.host = j.host AND s.segments = j.segments"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """All rounds as CTEs: nearest entries by whole squared distances, then floored means."""
    def nearest(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
  SELECT row, pieces.part, min({{'d': list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'e': entry}}) AS best
  FROM pieces JOIN book{k} ON pieces.part = book{k}.part GROUP BY row, pieces.part
)"""
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))
),
pieces AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS r(part)
),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS c FROM pieces WHERE row <= {entries})"""]
    for k in range(rounds):
        ctes += [nearest(k), f"""sums{k} AS MATERIALIZED (
  SELECT part, entry, place, sum(value)::BIGINT AS s, count(*) AS c FROM (
    SELECT part, best.e AS entry, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM near{k} JOIN pieces USING (row, part))
  GROUP BY part, entry, place
),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, b.c) AS c FROM book{k} AS b LEFT JOIN (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS m FROM sums{k} GROUP BY part, entry) USING (part, entry)
)"""]
    ctes += [nearest(rounds), f"""coded AS MATERIALIZED (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row
),
digest AS (
  SELECT sha256(string_agg(value::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS value, generate_subscripts(c, 1) AS place FROM book{rounds})
)"""]
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), digest"""


ORACLE: dict[str, str] = {
    "op3_benchmark_automaton": CONTAMINATION,
    "op5_offset_masks": CONVERSATIONS,
    "op7_hyperminhash_dedup": NEAR_DUPLICATES,
    "op10_warc_archive": ARCHIVE,
    "op11_interval_ranked_search": RANKED,
    "op12_path_template_filter": _templates(),
    "op13_gnat_vector_codes": _codes(),
}
