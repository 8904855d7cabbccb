"""SQL counterparts of the registered core queries, written for DuckDB over the same tables."""

from __future__ import annotations

# Records, their valid spans and their units.
D = """d AS (SELECT did, any_value(dataset) AS dataset, any_value(split) AS split, any_value(ord) AS ord, any_value(units) AS units, any_value(text) AS text, any_value(entities) AS entities
              FROM docs WHERE did IS NOT NULL AND units IS NOT NULL GROUP BY did),
       e AS (SELECT did, dataset, split, ord, units, len(units) AS n, ent_ord, x.start AS s, x."end" AS t, coalesce(x.type, '') AS type, x.surface AS surface
             FROM (SELECT *, generate_subscripts(entities, 1) - 1 AS ent_ord, unnest(entities) AS x FROM d) WHERE x.start >= 0 AND x.start < x."end" AND x."end" <= len(units)),
       u AS (SELECT did, dataset, split, ord, generate_subscripts(units, 1) - 1 AS pos, unnest(units) AS token FROM d)"""
# Classes of units, statistics of the train split, weights.
K = (
    D
    + """, ent AS (SELECT DISTINCT did, unnest(generate_series(s, t - 1)) AS pos FROM e),
       f AS (SELECT u.*, ent.pos IS NOT NULL AS is_e FROM u LEFT JOIN ent ON u.did = ent.did AND u.pos = ent.pos),
       k AS (SELECT *, CASE WHEN is_e THEN 'entity' WHEN max(is_e::INT) OVER (PARTITION BY did ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 THEN 'context' ELSE 'other' END AS cls FROM f),
       st AS (SELECT dataset, token, count(*) FILTER (cls = 'entity') AS n_e, count(*) FILTER (cls = 'context') AS n_c, count(*) FILTER (cls = 'other') AS n_o FROM k WHERE split = 'train' GROUP BY dataset, token),
       pr AS (SELECT *, n_e + n_c + n_o AS n, n_e::DOUBLE / (n_e + n_c + n_o) AS p_e, n_c::DOUBLE / (n_e + n_c + n_o) AS p_c, n_o::DOUBLE / (n_e + n_c + n_o) AS p_o FROM st),
       w AS (SELECT dataset, token, floor((p_e * 1.0 + p_c * 1.0 + p_o * 0.01::DOUBLE) * 1000000)::BIGINT AS w FROM pr)"""
)
LIB = """a AS (SELECT k.did, k.pos, any_value(k.cls) AS cls, CASE any_value(k.cls) WHEN 'entity' THEN max(e.ent_ord) FILTER (e.s <= k.pos AND k.pos < e.t) ELSE min(e.ent_ord) END AS ent_ord
               FROM k JOIN e ON k.did = e.did AND k.pos >= e.s - 2 AND k.pos < e.t + 2 WHERE k.cls <> 'other' GROUP BY k.did, k.pos),
          lib AS (SELECT k.dataset, k.token, k.cls, row_number() OVER (PARTITION BY k.dataset, k.token, k.cls ORDER BY k.ord, k.did, k.pos) AS rank,
                  CASE WHEN k.dataset = 'cmeee' THEN array_to_string(d.units[greatest(k.pos - 2, 0) + 1:least(k.pos + 3, len(d.units))], '') ELSE array_to_string(d.units[greatest(k.pos - 2, 0) + 1:least(k.pos + 3, len(d.units))], ' ') END AS text, e.surface AS name, e.type AS type
                  FROM k JOIN d ON k.did = d.did LEFT JOIN a ON k.did = a.did AND k.pos = a.pos LEFT JOIN e ON a.did = e.did AND a.ent_ord = e.ent_ord WHERE k.split = 'train')"""
# The rule's predictions: raw list order in o, gold and prediction sets of the evaluation splits.
P = """raw AS (SELECT did, dataset, ent_ord AS o, s, CASE WHEN h % 11 = 1 AND t < n THEN t + 1 ELSE t END AS t, CASE WHEN h % 13 = 2 THEN 'X' ELSE type END AS type
               FROM (SELECT *, ord * 31 + ent_ord * 17 + s * 7 AS h FROM e WHERE split IN ('dev', 'test')) WHERE h % 5 <> 0
               UNION ALL SELECT did, dataset, 1000000, 0, 1, 'X' FROM d WHERE split IN ('dev', 'test') AND ord % 4 = 0 AND len(units) > 0),
        p AS (SELECT did, dataset, s, t, type, min(o) AS o FROM raw GROUP BY did, dataset, s, t, type),
        g AS (SELECT DISTINCT did, dataset, s, t, type FROM e WHERE split IN ('dev', 'test')),
        b AS (SELECT coalesce(g.did, p.did) AS did, coalesce(g.dataset, p.dataset) AS dataset, coalesce(g.s, p.s) AS s, coalesce(g.t, p.t) AS t, coalesce(g.type, p.type) AS type, g.did IS NOT NULL AS in_g, p.did IS NOT NULL AS in_p
              FROM g FULL JOIN p ON g.did = p.did AND g.s = p.s AND g.t = p.t AND g.type = p.type)"""
# What a generator might say.
N = """said AS (SELECT did, dataset, ord, units, row_number() OVER (PARTITION BY did ORDER BY ent_ord) - 1 AS emit_ord, coalesce(surface, '') AS name, type FROM e),
        cnt AS (SELECT d.did, d.dataset, d.ord, d.units, count(said.did) AS c FROM d LEFT JOIN said ON d.did = said.did GROUP BY ALL),
        nm AS (SELECT did, dataset, units, emit_ord, name, type FROM said
               UNION ALL SELECT s.did, s.dataset, s.units, c, s.name, s.type FROM said s JOIN cnt ON s.did = cnt.did WHERE s.emit_ord = 0 AND s.ord % 3 = 0
               UNION ALL SELECT did, dataset, units, c + CASE WHEN ord % 3 = 0 AND c > 0 THEN 1 ELSE 0 END, 'no such name', 'X' FROM cnt WHERE ord % 7 = 0),
        tg AS (SELECT *, CASE WHEN dataset = 'cmeee' THEN list_filter(string_split(name, ''), lambda x: x <> '') ELSE list_filter(string_split_regex(name, '[\\s\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{00A0}]+'), lambda x: x <> '') END AS target FROM nm),
        oc AS (SELECT did, emit_ord, name, type, target, o, o + len(target) AS o_end FROM (SELECT *, unnest(generate_series(0, len(units) - len(target))) AS o FROM tg WHERE len(target) > 0 AND len(target) <= len(units)) WHERE units[o + 1:o + len(target)] = target)"""
PRF = "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 4) AS f1"
ROLES = """r AS (SELECT g.did, g.dataset, g.s, g.t, g.type, count(o.did) FILTER (o.s <= g.s AND g.t <= o.t) > 0 AS "inner", count(o.did) FILTER (g.s <= o.s AND o.t <= g.t) > 0 AS "outer",
                1 + count(o.did) FILTER (o.s <= g.s AND g.t <= o.t) AS depth, any_value(p.did IS NOT NULL) AS recovered
                FROM g LEFT JOIN e o ON g.did = o.did AND (o.s <> g.s OR o.t <> g.t) LEFT JOIN p ON g.did = p.did AND g.s = p.s AND g.t = p.t AND g.type = p.type GROUP BY g.did, g.dataset, g.s, g.t, g.type)"""
PICKS = """q AS (SELECT * FROM d WHERE split IN ('dev', 'test') AND ord % 20 = 0), pool AS (SELECT * FROM d WHERE split = 'train'),
           qt AS (SELECT DISTINCT did, dataset, unnest(units) AS token FROM q), pt AS (SELECT DISTINCT did, dataset, unnest(units) AS token FROM pool),
           sc AS (SELECT qt.did, pt.did AS pool_did, sum(coalesce(w.w, 1000000)) AS s FROM qt JOIN pt ON qt.dataset = pt.dataset AND qt.token = pt.token LEFT JOIN w ON qt.dataset = w.dataset AND qt.token = w.token GROUP BY qt.did, pt.did),
           every AS (SELECT q.did, pool.did AS pool_did, pool.ord AS pool_ord, coalesce(sc.s, 0)::BIGINT AS s_token FROM q JOIN pool ON q.dataset = pool.dataset AND q.did <> pool.did LEFT JOIN sc ON q.did = sc.did AND pool.did = sc.pool_did),
           picks AS (SELECT *, count(*) OVER (PARTITION BY did) - r + 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY s_token DESC, pool_ord DESC, pool_did DESC) AS r FROM every) WHERE r <= 8)"""
BYTE = "(('0x' || substr(sha256(token), 2 * i + 1, 2))::INT * 2 - 255)"
VEC = f"""tw AS (SELECT did, dataset, ord, split, token, count(*) AS n FROM u GROUP BY ALL),
          vd AS (SELECT tw.did, any_value(tw.dataset) AS dataset, any_value(tw.ord) AS ord, any_value(tw.split) AS split, i AS dim, sum(n * (coalesce(w.w, 1000000) // 1000) * {BYTE.replace('token', 'tw.token')})::BIGINT AS v
                 FROM tw LEFT JOIN w ON tw.dataset = w.dataset AND tw.token = w.token, generate_series(0, 15) AS z(i) GROUP BY tw.did, i)"""
COS = """vl AS (SELECT did, any_value(dataset) AS dataset, any_value(ord) AS ord, any_value(split) AS split, list(v ORDER BY dim) AS vec FROM vd GROUP BY did),
         nv AS (SELECT *, list_sum(list_transform(vec, lambda x: x::HUGEINT * x))::DOUBLE AS n2 FROM vl),
         cs AS (SELECT a.did, b.did AS pool_did, b.ord AS pool_ord, CASE WHEN a.n2 = 0 OR b.n2 = 0 THEN 0.0 ELSE list_sum(list_transform(generate_series(1, 16), lambda i: a.vec[i]::HUGEINT * b.vec[i]))::DOUBLE / (sqrt(a.n2) * sqrt(b.n2)) END AS c
                FROM nv a JOIN nv b ON a.dataset = b.dataset AND a.did <> b.did WHERE a.split IN ('dev', 'test') AND a.ord % 20 = 0 AND b.split = 'train')"""
ANS = "ans AS (SELECT key, min(text) AS text FROM llm_cache WHERE key IS NOT NULL GROUP BY key)"
ITEMS = """CASE WHEN json_type(o) = 'OBJECT' THEN coalesce(json_extract(o, '$.named_entities'), json_extract(o, '$."named entities"')) END"""
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_STR = "CASE WHEN json_type(json_extract(x, '$.{0}')) = 'VARCHAR' THEN json_extract_string(x, '$.{0}') END"
_LOOSE = "CASE WHEN json_extract(x, '$.type') IS NULL THEN '' WHEN json_type(json_extract(x, '$.type')) = 'NULL' THEN 'None' ELSE json_extract_string(x, '$.type') END"


def _json(x: str) -> str:
    """Strict JSON only: the cast would let a comma before a closing bracket pass."""
    return f"CASE WHEN NOT regexp_matches({x}, ',\\s*[\\]}}]') THEN try_cast(nullif({x}, '') AS JSON) END"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _units_of(spans: str, name: str) -> str:
    """Annotated units of the evaluation splits under the given spans."""
    return f"""{name} AS (SELECT u.did, u.dataset, u.pos, u.token, pr.n_e, pr.p_e, pr.p_c, pr.token IS NOT NULL AS seen, c.pos IS NOT NULL AS covered
               FROM u LEFT JOIN pr ON u.dataset = pr.dataset AND u.token = pr.token LEFT JOIN (SELECT DISTINCT did, unnest(generate_series(s, t - 1)) AS pos FROM {spans}) c ON u.did = c.did AND u.pos = c.pos WHERE u.split IN ('dev', 'test'))"""


def _unseen(units: str, name: str) -> str:
    return f"""{name} AS (SELECT did, pos, token, dataset FROM (SELECT *, max((seen AND (p_e >= 0.5 OR p_c >= 0.5))::INT) OVER (PARTITION BY did ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {units}) WHERE near = 1 AND NOT seen AND NOT covered)"""


def _fn(units: str, name: str) -> str:
    return f"{name} AS (SELECT did, pos, token, dataset FROM {units} WHERE seen AND NOT covered AND p_e > 0.95)"


def _added(before: str, hits: str, name: str, step: int) -> str:
    """Each trigger token, without blanks, becomes a span at its first trigger."""
    return f"""{name} AS (SELECT did, s, t, type, o FROM {before} UNION ALL
               SELECT did, min(pos), min(pos) + 1, 'mock', {step} + min(pos) FROM {hits} WHERE {_strip('token')} <> '' AND NOT regexp_matches(token, '[\\s\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{00A0}}]') GROUP BY did, token)"""


def _edges(spans: str, name: str) -> str:
    """Boundary triggers of numbered spans."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY did ORDER BY o) - 1 AS span_ord FROM {spans}),
      {name}_c AS (SELECT DISTINCT did, unnest(generate_series(s, t - 1)) AS pos FROM {spans}),
      {name} AS (SELECT x.did, x.span_ord, u.pos, u.token, CASE WHEN u.pos >= x.s AND u.pos < x.t THEN 'inside' ELSE 'outside' END AS side
               FROM {name}_n x JOIN u ON x.did = u.did AND u.pos >= x.s - 2 AND u.pos < x.t + 2 JOIN pr ON u.dataset = pr.dataset AND u.token = pr.token LEFT JOIN {name}_c c ON u.did = c.did AND u.pos = c.pos
               WHERE CASE WHEN u.pos >= x.s AND u.pos < x.t THEN (u.pos < x.s + 2 OR u.pos >= x.t - 2) AND p_c > p_e ELSE c.pos IS NULL AND p_e > p_c END)"""


def _trimmed(edges: str, name: str) -> str:
    """Spans whose last unit is a doubtful inside one lose it; its text's first occurrence over the old span is the new span."""
    return f"""{name}_x AS (SELECT n.did, n.span_ord, n.s, n.t, n.type, n.t - 1 AS new_t, d.units[n.s + 1:n.t - 1] AS target, d.units FROM {edges}_n n JOIN {edges} h ON n.did = h.did AND n.span_ord = h.span_ord AND h.pos = n.t - 1 AND h.side = 'inside' JOIN d ON n.did = d.did),
      {name}_o AS (SELECT did, span_ord, min(o) AS o FROM (SELECT did, span_ord, s, t, target, units, unnest(generate_series(greatest(0, s - len(target) + 1), least(t - 1, len(units) - len(target)))) AS o FROM {name}_x WHERE new_t > s) WHERE units[o + 1:o + len(target)] = target GROUP BY did, span_ord),
      {name} AS (SELECT n.did, n.span_ord, n.s AS old_s, n.t AS old_t, n.type AS old_type, CASE WHEN x.did IS NULL OR trim(n.type) = '' THEN n.type ELSE trim(n.type) END AS type, CASE WHEN x.did IS NULL THEN NULL WHEN x.new_t <= x.s THEN 'delete' ELSE 'trim' END AS action, CASE WHEN x.did IS NULL THEN n.s WHEN x.new_t > x.s THEN w.o END AS s, CASE WHEN x.did IS NULL THEN n.t WHEN x.new_t > x.s THEN w.o + len(x.target) END AS t
               FROM {edges}_n n LEFT JOIN {name}_x x ON n.did = x.did AND n.span_ord = x.span_ord LEFT JOIN {name}_o w ON n.did = w.did AND n.span_ord = w.span_ord)"""


_OUT = 'SELECT DISTINCT did, s::INT AS start, t::INT AS "end", type FROM'
_P0 = "p0 AS (SELECT did, s, t, type, o FROM p)"
_CHAIN = f"WITH {K}, {P}, {_P0}, {_units_of('p0', 'x0')}, {_unseen('x0', 'h0')}, {_added('p0', 'h0', 'p1', 2000000)}, {_units_of('p1', 'x1')}, {_fn('x1', 'h1')}, {_added('p1', 'h1', 'p2', 4000000)}, {_edges('p2', 'h2')}, {_trimmed('h2', 'p3')}"
_EDITS = """SELECT did, 'unseen' AS pass, 'add' AS action, token, min(pos) AS s, min(pos) + 1 AS t, 'mock' AS type, NULL AS old_s, NULL AS old_t, NULL AS old_type FROM h0 WHERE {plain} GROUP BY did, token
            UNION ALL SELECT did, 'fn', 'add', token, min(pos), min(pos) + 1, 'mock', NULL, NULL, NULL FROM h1 WHERE {plain} GROUP BY did, token
            UNION ALL SELECT did, 'boundary', action, NULL, s, t, type, old_s, old_t, old_type FROM p3 WHERE action IS NOT NULL""".replace("{plain}", "NOT regexp_matches(token, '[\\s\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{00A0}]')")

SQL: dict[str, str] = {
    "doc_units": f"WITH {D} SELECT did, pos::BIGINT AS pos, token FROM u",
    "gold_entities": f'WITH {D} SELECT did, ent_ord::INT AS ent_ord, s AS start, t AS "end", type, surface FROM e',
    "char_units": "SELECT term_id, (generate_subscripts(x, 1) - 1)::INT AS pos, unnest(x) AS unit FROM (SELECT term_id, CASE WHEN dataset = 'cmeee' THEN string_split(name, '') ELSE list_filter(string_split_regex(name, '\\s+'), lambda y: y <> '') END AS x FROM terms)",
    "bio_to_spans": f"""WITH {D}, n AS (SELECT * FROM u WHERE dataset = 'ncbi'),
        fe AS (SELECT n.*, f.s AS es, f.did IS NOT NULL AS has FROM n LEFT JOIN (SELECT did, pos, arg_min(s, ent_ord) AS s FROM (SELECT did, ent_ord, s, unnest(generate_series(s, t - 1)) AS pos FROM e) GROUP BY did, pos) f ON n.did = f.did AND n.pos = f.pos),
        tg AS (SELECT *, CASE WHEN NOT has THEN 'O' WHEN pos = es AND (ord + pos) % 3 <> 0 THEN 'B-Disease' WHEN (ord + pos) % 7 = 0 THEN 'I-Other' ELSE 'I-Disease' END AS tag FROM fe),
        lg AS (SELECT *, lag(tag) OVER (PARTITION BY did ORDER BY pos) AS prev FROM tg),
        br AS (SELECT *, (tag LIKE 'B-%' OR (tag LIKE 'I-%' AND (prev IS NULL OR prev = 'O'))) AS start_, (tag NOT LIKE 'I-%' OR prev IS NULL OR prev = 'O') AS brk FROM lg),
        gr AS (SELECT *, sum((start_ OR brk)::INT) OVER (PARTITION BY did ORDER BY pos) AS grp FROM br)
        SELECT did, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end", split_part(arg_min(tag, pos), '-', 2) AS type, string_agg(token, ' ' ORDER BY pos) AS surface FROM gr GROUP BY did, grp HAVING arg_min(start_, pos)""",
    "type_remap": f"WITH {D} SELECT CASE type WHEN 'dis' THEN '疾病' WHEN 'sym' THEN '临床表现' WHEN 'dru' THEN '药物' WHEN 'equ' THEN '医疗设备' WHEN 'pro' THEN '医疗程序' WHEN 'bod' THEN '身体' WHEN 'ite' THEN '医学检验项目' WHEN 'mic' THEN '微生物类' WHEN 'dep' THEN '科室' ELSE type END AS type, count(*) AS n FROM e WHERE dataset = 'cmeee' GROUP BY 1",
    "type_codes": f"""WITH {D}, names AS (SELECT dataset, min(code) AS code, k FROM (SELECT dataset, code, regexp_replace(lower(trim(unnest([code, full_name]))), '[\\s_-]+', '_', 'g') AS k FROM entity_types) GROUP BY dataset, k)
        SELECT e.type AS raw, names.code, count(*) AS n FROM e LEFT JOIN names ON e.dataset = names.dataset AND regexp_replace(lower(trim(e.type)), '[\\s_-]+', '_', 'g') = names.k GROUP BY ALL""",
    "verify_offsets": f"WITH {D} SELECT dataset, count(*) AS total, count(*) FILTER (CASE WHEN dataset = 'cmeee' THEN array_to_string(units[s + 1:t], '') ELSE array_to_string(units[s + 1:t], ' ') END IS DISTINCT FROM surface) AS mismatch FROM e GROUP BY dataset",
    "slice_select": f"WITH {D}, m AS (SELECT dataset, split, max(ord) + 1 AS n FROM d GROUP BY ALL) SELECT d.dataset, d.split, did, ord FROM d JOIN m ON d.dataset = m.dataset AND d.split = m.split WHERE ord >= 10 AND ord < greatest(n - 5, 0)",
    "hash_sample": f"WITH {D} SELECT did FROM d WHERE split = 'train' ORDER BY sha256('13' || did), did LIMIT 50",
    "token_class": f"WITH {K} SELECT did, cls, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM k GROUP BY ALL",
    "token_stats": f"WITH {K} SELECT dataset, token, n_e, n_c, n_o FROM st",
    "token_probs": f"WITH {K} SELECT dataset, token, n, p_e, p_c, p_o FROM pr",
    "token_weights": f"WITH {K} SELECT dataset, token, w FROM w",
    "span_library": f"WITH {K}, {LIB} SELECT dataset, token, cls, rank::INT AS rank, text, name, type FROM lib WHERE rank <= 50",
    "unit_association": f"WITH {K}, {LIB} SELECT a.did, a.pos::BIGINT AS pos, a.cls, a.ent_ord::INT AS ent_ord FROM a JOIN d ON a.did = d.did WHERE d.split = 'train'",
    "stats_validation": f"""WITH {K}, h AS (SELECT token, sum(n_e)::DOUBLE AS a, sum(n_c)::DOUBLE AS b, sum(n_o)::DOUBLE AS c FROM st GROUP BY token), want(token, a, b, c) AS (VALUES ('of', 0, 200, 800), ('disease', 80, 5, 15), ('no such token', 1, 0, 0)),
        x AS (SELECT want.token, h.token IS NOT NULL AS there, greatest(abs(want.a::DOUBLE / (want.a + want.b + want.c) - coalesce(h.a / (h.a + h.b + h.c), 0)), abs(want.b::DOUBLE / (want.a + want.b + want.c) - coalesce(h.b / (h.a + h.b + h.c), 0)), abs(want.c::DOUBLE / (want.a + want.b + want.c) - coalesce(h.c / (h.a + h.b + h.c), 0))) AS worst FROM want LEFT JOIN h ON want.token = h.token)
        SELECT token, worst, there AND worst <= 0.01 AS ok FROM x""",
    "stats_delta": f"""WITH {K}, s AS (SELECT dataset, token, sum(a)::BIGINT AS s_n_e, sum(b)::BIGINT AS s_n_c, sum(c)::BIGINT AS s_n_o FROM (SELECT DISTINCT dataset, shard, token, coalesce(n_e, 0) AS a, coalesce(n_c, 0) AS b, coalesce(n_o, 0) AS c FROM token_stats WHERE token IS NOT NULL) GROUP BY ALL)
        SELECT coalesce(st.dataset, s.dataset) AS dataset, coalesce(st.token, s.token) AS token, n_e, n_c, n_o, s_n_e, s_n_c, s_n_o FROM st FULL JOIN s ON st.dataset = s.dataset AND st.token = s.token WHERE coalesce(n_e, 0) <> coalesce(s_n_e, 0) OR coalesce(n_c, 0) <> coalesce(s_n_c, 0) OR coalesce(n_o, 0) <> coalesce(s_n_o, 0)""",
    "vocabulary": f"WITH {D} SELECT dataset, count(DISTINCT token) AS n FROM u GROUP BY dataset",
    "inverted_index": f"WITH {D} SELECT dataset, token, count(DISTINCT did) AS n_docs, sum(ord)::BIGINT AS ord_sum FROM (SELECT DISTINCT dataset, token, did, ord FROM u WHERE split = 'train') GROUP BY ALL",
    "retrieve_token_topk": f"WITH {K}, {PICKS} SELECT did, pool_did, s_token, rank::BIGINT AS rank FROM picks",
    "token_vectors_all": f"WITH {D}, v AS (SELECT DISTINCT dataset, token FROM u) SELECT dataset, token, i::INT AS dim, {BYTE}::BIGINT AS v FROM v, generate_series(0, 15) AS z(i)",
    "token_vectors": f"WITH {D}, v AS (SELECT DISTINCT dataset, token FROM u WHERE split IN ('dev', 'test') AND ord % 20 = 0) SELECT dataset, token, i::INT AS dim, {BYTE}::BIGINT AS v FROM v, generate_series(0, 15) AS z(i)",
    "sentence_vectors": f"WITH {K}, {VEC} SELECT did, dim::INT AS dim, v FROM vd",
    "retrieve_embed_topk": f"WITH {K}, {VEC}, {COS} SELECT did, pool_did, floor(c * 1000000)::BIGINT AS cos_ppm FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY c DESC, pool_ord DESC, pool_did DESC) AS r FROM cs) WHERE r <= 8",
    "retrieve_hybrid_topk": f"""WITH {K}, {PICKS}, {VEC}, {COS} SELECT did, pool_did, score FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY score DESC, pool_ord DESC, pool_did DESC) AS r
        FROM (SELECT cs.did, cs.pool_did, cs.pool_ord, (coalesce(sc.s, 0) + floor(c * 1000000))::BIGINT AS score FROM cs LEFT JOIN sc ON cs.did = sc.did AND cs.pool_did = sc.pool_did)) WHERE r <= 8""",
    "embedding_knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 10000)::BIGINT) AS v FROM embeddings), n AS (SELECT *, list_sum(list_transform(v, lambda x: x * x))::DOUBLE AS n2 FROM v),
        c AS (SELECT a.vec_id, b.vec_id AS near_id, CASE WHEN a.n2 = 0 OR b.n2 = 0 THEN 0.0 ELSE list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::DOUBLE / (sqrt(a.n2) * sqrt(b.n2)) END AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT vec_id, near_id, floor(c * 1000000)::BIGINT AS cos_ppm FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, near_id DESC) AS r FROM c) WHERE r <= 5""",
    "demo_lookup": f"""WITH {K}, {PICKS}, ne AS (SELECT did, count(*) AS n FROM e GROUP BY did) SELECT picks.did, (picks.rank - 1)::INT AS place, d.text, coalesce(ne.n, 0)::INT AS n_ents FROM picks JOIN d ON picks.pool_did = d.did LEFT JOIN ne ON d.did = ne.did""",
    "parse_entities": f"""WITH {ANS}, b AS (SELECT key, {_strip("regexp_replace(" + _strip("regexp_replace(" + _strip('text') + ", '^```(json)?', '')") + ", '```$', '')")} AS bare FROM ans),
        o AS (SELECT key, coalesce({_json('bare')}, {_json("regexp_extract(bare, '(?s)\\{.*\\}')")}) AS o FROM b), i AS (SELECT key, {ITEMS} AS l FROM o),
        x AS (SELECT key, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM (SELECT key, json_extract(l, '$[*]') AS l FROM i WHERE json_type(l) = 'ARRAY')),
        v AS (SELECT key, n, {_strip(_STR.format('name'))} AS name, {_strip(_STR.format('type'))} AS type FROM x WHERE json_type(x) = 'OBJECT')
        SELECT key, (row_number() OVER (PARTITION BY key ORDER BY n) - 1)::INT AS place, name, type FROM v WHERE name <> '' AND type IS NOT NULL""",
    "parse_reflection": f"""WITH {ANS}, b AS (SELECT key, CASE WHEN regexp_matches(text, 'Final predicted|最终预测实体') THEN regexp_extract(text, '(?s)^.*((?:Final predicted|最终预测实体).*)$', 1) ELSE text END AS t FROM ans),
        o AS (SELECT key, {_json("regexp_extract(t, '(?s)\\{.*\\}')")} AS o FROM b), i AS (SELECT key, {ITEMS} AS l FROM o),
        x AS (SELECT key, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM (SELECT key, json_extract(l, '$[*]') AS l FROM i WHERE json_type(l) = 'ARRAY')),
        v AS (SELECT key, n, {_strip(_STR.format('name'))} AS name, {_strip(_LOOSE)} AS type FROM x WHERE json_type(x) = 'OBJECT')
        SELECT key, (row_number() OVER (PARTITION BY key ORDER BY n) - 1)::INT AS place, name, type FROM v WHERE name <> ''""",
    "parse_boundary": f"""WITH {ANS}, b AS (SELECT key, CASE WHEN regexp_matches(text, 'Updated Predicted Entity|修正后的预测实体') THEN regexp_extract(text, '(?s)^.*((?:Updated Predicted Entity|修正后的预测实体).*)$', 1) ELSE text END AS t FROM ans),
        l AS (SELECT key, regexp_extract_all(t, '(?s)\\{{.*?\\}}') AS l FROM b), x AS (SELECT key, n, {_json('x')} AS x FROM (SELECT key, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM l)),
        v AS (SELECT key, n, CASE WHEN x = '{{}}' THEN 'delete' WHEN {_strip(_STR.format('name'))} <> '' THEN 'entity' END AS action, {_strip(_STR.format('name'))} AS name, {_strip(_LOOSE)} AS type FROM x WHERE json_type(x) = 'OBJECT'),
        z AS (SELECT key, arg_max(action, n) AS action, arg_max(CASE WHEN action = 'entity' THEN name ELSE '' END, n) AS name, arg_max(CASE WHEN action = 'entity' THEN type ELSE '' END, n) AS type FROM v WHERE action IS NOT NULL GROUP BY key)
        SELECT ans.key, coalesce(z.action, 'keep') AS action, CASE WHEN z.action = 'entity' THEN z.name END AS name, CASE WHEN z.action = 'entity' THEN z.type END AS type FROM ans LEFT JOIN z ON ans.key = z.key""",
    "find_occurrences": f'WITH {D}, {N} SELECT DISTINCT did, name, o::INT AS start, o_end::INT AS "end" FROM oc',
    "align_greedy": f"""WITH {D}, {N}, t AS (SELECT *, row_number() OVER (PARTITION BY did, target ORDER BY emit_ord) AS k FROM tg), r AS (SELECT *, row_number() OVER (PARTITION BY did, emit_ord ORDER BY o) AS k, count(*) OVER (PARTITION BY did, emit_ord) AS c FROM oc), c AS (SELECT did, emit_ord, count(*) AS c FROM oc GROUP BY ALL)
        SELECT t.did, t.emit_ord::INT AS emit_ord, t.name, t.type, r.o::INT AS start, r.o_end::INT AS "end", CASE WHEN r.o IS NULL THEN 'unaligned' ELSE 'aligned' END AS status, coalesce(c.c, 0)::INT AS n_candidates FROM t LEFT JOIN r ON t.did = r.did AND t.emit_ord = r.emit_ord AND t.k = r.k LEFT JOIN c ON t.did = c.did AND t.emit_ord = c.emit_ord""",
    "align_prefer_within": f"""WITH {D}, {N}, t AS (SELECT *, row_number() OVER (PARTITION BY did, target ORDER BY emit_ord) AS k FROM tg), r AS (SELECT oc.*, row_number() OVER (PARTITION BY oc.did, oc.emit_ord ORDER BY (oc.o >= len(d.units) // 2)::INT DESC, oc.o) AS k FROM oc JOIN d ON oc.did = d.did), c AS (SELECT did, emit_ord, count(*) AS c FROM oc GROUP BY ALL)
        SELECT t.did, t.emit_ord::INT AS emit_ord, r.o::INT AS start, r.o_end::INT AS "end", CASE WHEN r.o IS NULL THEN 'unaligned' ELSE 'aligned' END AS status, coalesce(c.c, 0)::INT AS n_candidates FROM t LEFT JOIN r ON t.did = r.did AND t.emit_ord = r.emit_ord AND t.k = r.k LEFT JOIN c ON t.did = c.did AND t.emit_ord = c.emit_ord""",
    "resolve_anchor": f"""WITH {D}, {N}, r AS (SELECT oc.*, (len(d.units) // 2 >= oc.o AND len(d.units) // 2 < oc.o_end) OR (greatest(len(d.units) - 2, 0) >= oc.o AND greatest(len(d.units) - 2, 0) < oc.o_end) AS covers FROM oc JOIN d ON oc.did = d.did)
        SELECT did, emit_ord::INT AS emit_ord, o::INT AS start, o_end::INT AS "end", type FROM (SELECT *, row_number() OVER (PARTITION BY did, emit_ord ORDER BY covers DESC, o) AS k FROM r) WHERE k = 1""",
    "gold_roundtrip": f"""WITH {D}, tg AS (SELECT did, units, ent_ord, type, CASE WHEN dataset = 'cmeee' THEN list_filter(string_split(coalesce(surface, ''), ''), lambda x: x <> '') ELSE list_filter(string_split_regex(coalesce(surface, ''), '[\\s\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{00A0}}]+'), lambda x: x <> '') END AS target FROM e),
        t AS (SELECT *, row_number() OVER (PARTITION BY did, target ORDER BY ent_ord) AS k FROM tg),
        oc AS (SELECT did, ent_ord, o, row_number() OVER (PARTITION BY did, ent_ord ORDER BY o) AS k FROM (SELECT *, unnest(generate_series(0, len(units) - len(target))) AS o FROM tg WHERE len(target) > 0 AND len(target) <= len(units)) WHERE units[o + 1:o + len(target)] = target),
        al AS (SELECT DISTINCT t.did, oc.o AS s, oc.o + len(t.target) AS t, t.type FROM t JOIN oc ON t.did = oc.did AND t.ent_ord = oc.ent_ord AND t.k = oc.k), gg AS (SELECT DISTINCT did, s, t, type FROM e),
        m AS (SELECT gg.did, count(*) AS n, count(al.did) AS r FROM gg LEFT JOIN al ON gg.did = al.did AND gg.s = al.s AND gg.t = al.t AND gg.type = al.type GROUP BY gg.did)
        SELECT d.dataset, d.did, coalesce(m.n, 0)::INT AS golds, coalesce(m.r, 0)::INT AS recovered, coalesce(m.n, 0) = coalesce(m.r, 0) AS complete FROM d LEFT JOIN m ON d.did = m.did""",
    "pipeline_align_counts": f"""WITH {D}, {N}, t AS (SELECT *, row_number() OVER (PARTITION BY did, target ORDER BY emit_ord) AS k FROM tg), c AS (SELECT did, emit_ord, count(*) AS c FROM oc GROUP BY ALL)
        SELECT CASE WHEN k <= coalesce(c.c, 0) THEN 'aligned' ELSE 'unaligned' END AS status, count(*) AS n, sum(coalesce(c.c, 0))::BIGINT AS candidates FROM t LEFT JOIN c ON t.did = c.did AND t.emit_ord = c.emit_ord GROUP BY 1""",
    "covered_units": f"WITH {D}, {P} SELECT DISTINCT did, unnest(generate_series(s, t - 1))::INT AS pos FROM p",
    "trigger_unseen": f"WITH {K}, {P}, {_units_of('p', 'x')}, {_unseen('x', 'h')} SELECT did, pos::INT AS pos, token FROM h",
    "trigger_fn": f"WITH {K}, {P}, {_units_of('p', 'x')}, {_fn('x', 'h')} SELECT did, pos::INT AS pos, token FROM h",
    "trigger_boundary": f"WITH {K}, {P}, {_P0}, {_edges('p0', 'h')} SELECT did, span_ord::INT AS span_ord, pos::INT AS pos, token, side FROM h",
    "neighbor_examples": f"""WITH {K}, {LIB}, {P}, {_units_of('p', 'x')}, {_unseen('x', 'h')}
        SELECT h.did, h.pos::INT AS pos, x.pos::INT AS neighbor_pos, x.token AS neighbor, lib.rank::INT AS rank, lib.text, lib.name, lib.type FROM h JOIN x ON h.did = x.did AND abs(h.pos - x.pos) <= 2 AND h.pos <> x.pos AND x.seen LEFT JOIN lib ON x.dataset = lib.dataset AND x.token = lib.token AND lib.cls = 'entity' AND lib.rank <= 1""",
    "example_buckets": f"WITH {K}, {LIB}, {P}, {_units_of('p', 'x')}, {_fn('x', 'h')} SELECT h.did, h.pos::INT AS pos, h.token, lib.cls, lib.rank::INT AS rank, lib.text, lib.name, lib.type FROM h JOIN lib ON h.dataset = lib.dataset AND h.token = lib.token AND lib.rank <= 1",
    "reflect_unseen": f"WITH {K}, {P}, {_P0}, {_units_of('p0', 'x0')}, {_unseen('x0', 'h0')}, {_added('p0', 'h0', 'p1', 2000000)} {_OUT} p1",
    "reflect_fn": f"WITH {K}, {P}, {_P0}, {_units_of('p0', 'x0')}, {_fn('x0', 'h0')}, {_added('p0', 'h0', 'p1', 2000000)} {_OUT} p1",
    "reflect_boundary": f"WITH {K}, {P}, {_P0}, {_edges('p0', 'h0')}, {_trimmed('h0', 'p1')} {_OUT} p1 WHERE s IS NOT NULL",
    "reflect_full": f"{_CHAIN} {_OUT} p3 WHERE s IS NOT NULL",
    "edit_attribution": f"""{_CHAIN}, ed AS ({_EDITS}), gs AS (SELECT DISTINCT did, s, t, type FROM e), j AS (SELECT ed.*, gn.did IS NOT NULL AS has_new, go.did IS NOT NULL AS has_old FROM ed LEFT JOIN gs gn ON ed.did = gn.did AND ed.s = gn.s AND ed.t = gn.t AND ed.type = gn.type LEFT JOIN gs go ON ed.did = go.did AND ed.old_s = go.s AND ed.old_t = go.t AND ed.old_type = go.type)
        SELECT pass, CASE WHEN action = 'add' THEN CASE WHEN has_new THEN 'add_correct' ELSE 'add_wrong' END WHEN action = 'trim' THEN CASE WHEN has_new AND NOT has_old THEN 'trim_fixed' WHEN has_old AND NOT has_new THEN 'trim_broke' ELSE 'trim_neutral' END WHEN has_old THEN 'delete_good' ELSE 'delete_fp' END AS outcome, count(*) AS n FROM j GROUP BY ALL""",
    "wrong_add_overlap": f"""{_CHAIN}, ed AS ({_EDITS}) SELECT ed.did, pass, token, ed.s::INT AS start, ed.t::INT AS "end", count(o.did)::INT AS overlapping, count(o.did) > 0 AS boundary_error FROM ed LEFT JOIN e o ON ed.did = o.did AND o.s < ed.t AND o.t > ed.s WHERE action = 'add' GROUP BY ed.did, pass, token, ed.s, ed.t""",
    "strict_micro_prf": f"WITH {D}, {P}, c AS (SELECT dataset, count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (NOT in_g) AS fp, count(*) FILTER (NOT in_p) AS fn FROM b GROUP BY dataset) SELECT dataset, tp, fp, fn, {PRF} FROM c",
    "per_type_prf": f"WITH {D}, {P}, c AS (SELECT dataset, type, count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (NOT in_g) AS fp, count(*) FILTER (NOT in_p) AS fn FROM b GROUP BY dataset, type) SELECT dataset, type, tp, fp, fn, {PRF} FROM c",
    "nesting_roles": f'WITH {D}, {P}, {ROLES} SELECT did, s AS start, t AS "end", type, "inner", "outer", depth::INT AS depth, recovered FROM r',
    "nested_recall": f"""WITH {D}, {P}, {ROLES} SELECT dataset, CASE WHEN "inner" OR "outer" THEN 'nested' ELSE 'flat' END AS subset, count(*) FILTER (recovered) AS recovered, count(*) AS total FROM r GROUP BY ALL""",
    "error_rates": f"""WITH {D}, {P}, {ROLES}, x AS (SELECT a.dataset, count(*) AS pairs, count(*) FILTER (pa.did IS NOT NULL AND pb.did IS NOT NULL) AS pairs_recovered FROM e a JOIN e o ON a.did = o.did AND o.s <= a.s AND a.t <= o.t AND (o.s <> a.s OR o.t <> a.t) LEFT JOIN p pa ON a.did = pa.did AND a.s = pa.s AND a.t = pa.t AND a.type = pa.type LEFT JOIN p pb ON o.did = pb.did AND o.s = pb.s AND o.t = pb.t AND o.type = pb.type WHERE a.split IN ('dev', 'test') GROUP BY a.dataset)
        SELECT r.dataset, count(*) FILTER ("inner" AND NOT recovered) AS inner_missed, count(*) FILTER ("inner") AS "inner", count(*) FILTER ("outer" AND NOT recovered) AS outer_missed, count(*) FILTER ("outer") AS "outer", coalesce(any_value(x.pairs), 0) AS pairs, coalesce(any_value(x.pairs_recovered), 0) AS pairs_recovered FROM r LEFT JOIN x ON r.dataset = x.dataset GROUP BY r.dataset""",
    "depth_recall": f"WITH {D}, {P}, {ROLES} SELECT dataset, depth::INT AS depth, count(*) FILTER (recovered) AS recovered, count(*) AS total FROM r GROUP BY ALL",
    "span_set_ops": f"""WITH {D}, {P}, c AS (SELECT did, count(*) FILTER (in_g AND in_p) AS a, count(*) FILTER (in_g AND NOT in_p) AS g, count(*) FILTER (in_p AND NOT in_g) AS p, count(*) AS n FROM b GROUP BY did) SELECT d.did, coalesce(a, 0)::INT AS common, coalesce(g, 0)::INT AS only_gold, coalesce(p, 0)::INT AS only_pred, coalesce(n, 0)::INT AS either, coalesce(g, 0) = 0 AS all_recovered FROM d LEFT JOIN c ON d.did = c.did WHERE d.split IN ('dev', 'test')""",
    "stratified_distance": f"""WITH {D}, r AS (SELECT *, ord % 10 = 0 AS p FROM d WHERE split = 'train'), x AS (SELECT e.dataset, e.type, count(*) AS tc, count(*) FILTER (r.p) AS c FROM e JOIN r ON e.did = r.did GROUP BY ALL), t AS (SELECT dataset, sum(tc) AS a, sum(c) AS o FROM x GROUP BY dataset), n AS (SELECT dataset, count(*) AS nd, count(*) FILTER (p) AS ns FROM r GROUP BY dataset)
        SELECT x.dataset, round(sum(abs(c::DOUBLE / nullif(o, 0) - tc::DOUBLE / a)), 9) AS l1_distance, round(sum(abs(c - tc * ns::DOUBLE / nd)) / nullif(any_value(a::DOUBLE / nd * ns), 0), 9) AS count_distance FROM x JOIN t ON x.dataset = t.dataset JOIN n ON x.dataset = n.dataset GROUP BY x.dataset""",
    "llm_cache_hits": """WITH l AS (SELECT key, arg_max({'text': text, 'p': prompt_tokens, 'c': completion_tokens}, (written_at, text)) AS x FROM llm_cache WHERE key IS NOT NULL GROUP BY key), r AS (SELECT DISTINCT CASE WHEN substr(key, 1, 1) = '0' THEN 'absent-' || key ELSE key END AS key FROM llm_cache WHERE key IS NOT NULL)
        SELECT r.key, l.x.text AS text, l.x.p AS prompt_tokens, l.x.c AS completion_tokens, l.key IS NOT NULL AS cached FROM r LEFT JOIN l ON r.key = l.key""",
    "llm_cache_misses": "SELECT DISTINCT 'absent-' || substr(key, 1, 3) AS key FROM llm_cache WHERE key IS NOT NULL",
    "usage_counters": "SELECT run_id, count(*) AS answers, coalesce(sum(a), 0)::BIGINT AS tokens_in, coalesce(sum(b), 0)::BIGINT AS tokens_out, count(*) FILTER (a IS NULL OR b IS NULL) AS unknown FROM (SELECT key, min(run_id) AS run_id, max(prompt_tokens) AS a, max(completion_tokens) AS b FROM llm_cache WHERE key IS NOT NULL GROUP BY key) GROUP BY run_id",
    "token_stat_json": f"""WITH {K} SELECT dataset, token, '{{"num_occurrences_as_entity": ' || n_e || ', "num_occurrences_as_context_tokens": ' || n_c || ', "num_occurrences_as_other_tokens": ' || n_o || ', "entity_vs_context_count": "' || n_e || ' vs ' || n_c || '", "entity_vs_non_entity_count": "' || n_e || ' vs ' || (n_c + n_o) || '"}}' AS stat FROM st""",
    "perdoc_dump": f"""WITH {D}, {P}, gl AS (SELECT did, string_agg(s || ':' || t || ':' || type, '|' ORDER BY s, t, type) AS x FROM g GROUP BY did), pl AS (SELECT did, string_agg(s || ':' || t || ':' || type, '|' ORDER BY s, t, type) AS x FROM p GROUP BY did) SELECT d.did, coalesce(gl.x, '') AS gold, coalesce(pl.x, '') AS pred FROM d LEFT JOIN gl ON d.did = gl.did LEFT JOIN pl ON d.did = pl.did WHERE d.split IN ('dev', 'test')""",
}
