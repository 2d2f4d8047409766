"""SQL for DuckDB that gives the rows of the queries that SQL can express.

The others (op2, op3, op5, op7, op10, op12: token ids, a battery and trained models) are held against brute force in tests/llm.
"""

from __future__ import annotations

from lumengrid.llm.mixing import DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"

NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, len(e)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

RULES = f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
a AS (SELECT doc_id, i FROM g WHERE (doc_id, g) IN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1)),
c AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM a) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, source AS host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.k, 0) AS n_dup_lines, coalesce(c.k, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS lines FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines >= lines AS failed FROM b),
h AS (SELECT host, count(*) AS n, count_if(failed) AS f FROM f WHERE host IS NOT NULL GROUP BY host),
z AS (SELECT least(greatest(sum(f) / sum(n), 0.0001), 0.9999)::DOUBLE AS mean, var_samp(f / n) AS spread, avg(1 / n) AS inverse FROM h),
y AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(coalesce(spread, 0) - mean * (1 - mean) * inverse, 0.000001) - 1, 2.0), 1000.0) AS k FROM z),
x AS (SELECT host, n, f, mean, mean * k + f AS a, (1 - mean) * k + n - f AS b FROM h, y),
d AS (SELECT host, n, f, a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 3 * mean / (1 - mean) / (1 + 3 * mean / (1 - mean)) AS dropped FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(dropped, false) AS kept,
  coalesce(d.n, 0) AS host_docs, coalesce(d.f, 0)::BIGINT AS host_failures, coalesce(dropped, false) AS host_dropped FROM f LEFT JOIN d USING (host)"""


def _case(column: str, weights: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in reversed(weights.items())) + " ELSE 0.05 END::DOUBLE"


def _level(name: str, source: str, parent: str, key: str, weight: str, budget: str) -> str:
    """Children of one level with their shares of the parents' budgets."""
    by = f"PARTITION BY {parent} " if parent else ""
    keys = f"{parent}, {key}" if parent else key
    return f"""{name}_c AS (SELECT {keys}, sum(tokens) * 2.0::DOUBLE AS capacity, {weight} AS weight, {budget} AS budget FROM {source} GROUP BY {keys}{', budget' if budget == 'budget' else ''}),
{name}_l AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({by}ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER ({by.strip()}) - coalesce(sum(weight) OVER ({by}ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM {name}_c),
{name} AS (SELECT {keys}, least(capacity, weight * max(level) OVER ({by.strip()})) AS budget FROM {name}_l)"""


MIX = f"""WITH base AS (SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4) AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
{_level("dom", "leaves", "", "domain", _case("domain", DOMAIN_WEIGHTS), "(SELECT sum(tokens) * 0.8::DOUBLE FROM leaves)")},
lang_in AS (SELECT leaves.*, budget FROM leaves JOIN dom USING (domain)),
{_level("lan", "lang_in", "domain", "language", _case("language", LANGUAGE_WEIGHTS), "budget")},
org_in AS (SELECT leaves.*, budget FROM leaves JOIN lan USING (domain, language)),
{_level("org", "org_in", "domain, language", "origin", "1.0::DOUBLE", "budget")},
b AS (SELECT leaves.*, floor(budget + 0.000001)::BIGINT AS budget FROM leaves JOIN org USING (domain, language, origin)),
q AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN budget // tokens ELSE 2 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 2 END * tokens AS rest FROM b),
r AS (SELECT base.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), doc_id) AS upto FROM base JOIN q USING (domain, language, origin))
SELECT doc_id, domain, language, origin, tokens, (whole + (rest > 0 AND upto <= rest)::BIGINT)::BIGINT AS copies FROM r"""

CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, chr(10) || '</turn>' || chr(10) AS tail, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS mild FROM c),
f AS (SELECT *, 7 + length(role) + 1 + length(tail) + length(CASE WHEN contains(text, '\') OR strpos(text || tail, tail) <= length(text) THEN mild ELSE text END) AS size FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""



def _said(field: str) -> str:
    return f"coalesce(octet_length(encode({field}::VARCHAR)) || ':' || {field}::VARCHAR, '-')"


def _tree(name: str, leaves: str, part: str) -> str:
    """Nodes of all levels of the trees of ``part`` over ``leaves`` (part, i, h, n), and what stands left and right of each."""
    return f"""{name} AS (SELECT {part}, 0 AS lvl, i, h, n FROM {leaves}
  UNION ALL SELECT {part}, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {part}, lvl, i // 3, n),
{name}_s AS (SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY {part}, lvl, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY {part}, lvl, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name})"""


#: crc32, bit by bit, as DuckDB has none.
CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
  lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda y, k: xor(y >> 1, (y & 1) * 3988292384::UBIGINT)))"""

MANIFEST = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS k, sha256({' || '.join(map(_said, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf FROM documents),
t AS (SELECT k, doc_id, source, leaf, CASE WHEN xor({CRC}, 4294967295::UBIGINT) % 2 = 0 THEN sha256({' || '.join(map(_said, ('doc_id', 'source', 'lang', 'n_chars', "replace(text, chr(10), '')")))}) ELSE leaf END AS x FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM t),
{_tree('a', 'w', 'source')},
b0 AS (SELECT 0 AS part, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM a WHERE n = 1),
{_tree('b', 'b0', 'part')},
f AS (SELECT k, source, doc_id, leaf, 0 AS lvl, i, n, x, '' AS proof FROM w
  UNION ALL SELECT k, f.source, doc_id, leaf, f.lvl + 1, f.i // 3, (f.n + 2) // 3, sha256(l || x || r), proof || l || r FROM f JOIN a_s s ON s.source IS NOT DISTINCT FROM f.source AND s.lvl = f.lvl AND s.i = f.i WHERE f.n > 1),
g AS (SELECT k, doc_id, leaf, b0.h AS subroot, 0 AS lvl, b0.i, b0.n, x, proof FROM f JOIN b0 ON b0.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL SELECT k, doc_id, leaf, subroot, g.lvl + 1, g.i // 3, (g.n + 2) // 3, sha256(l || x || r), proof || l || r FROM g JOIN b_s s ON s.lvl = g.lvl AND s.i = g.i WHERE g.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM g, (SELECT h AS root FROM b WHERE n = 1) WHERE n = 1"""



def _lloyd(rounds: int) -> str:
    """Plain Lloyd rounds, one after the other."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, c, d FROM (SELECT v.r, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v, c{t} k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM c{t} k LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e
  FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{t} JOIN u USING (r) GROUP BY c, j) GROUP BY c) m USING (c))""")
    return ",\n".join(steps)


LLOYD = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT r, unnest(range(64)) AS j, unnest(e) AS x FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS c, e FROM v QUALIFY c < 40),
{_lloyd(5)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.e, ',')) AS centroid_sha256 FROM a5 JOIN v USING (r) JOIN c5 USING (c)"""

ORACLE_SQL: dict[str, str] = {"op1_block_nearest": NEAREST, "op4_minhash_dedup": DEDUP, "op6_quality_rules": RULES, "op8_mix_sources": MIX, "op9_chat_format": CHAT, "op11_merkle_manifest": MANIFEST, "op13_ns_bounds": LLOYD}
