"""DuckDB SQL for the operators that SQL can express: plain definitions over all rows, without any index or hash.

Tokens of a vocabulary and models cannot be expressed; tests/llm holds those operators against brute force.
"""

from __future__ import annotations

from . import licenses, mixing, secrets, vector_search

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(x) for x in range(0xC0, 0xDF) if x != 0xD7)
_LOWER = "".join(chr(ord(x) + 32) for x in _UPPER)


def _words(text: str) -> str:
    """Lower-cased runs of ASCII letters, digits and all other characters that are not ASCII."""
    return rf"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '')"


def _shingles(w: str) -> str:
    return f"CASE WHEN len({w}) >= 5 THEN list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' ')) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"


def _say(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op1() -> str:
    words = lambda text: f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    notices = ", ".join(f"({_say(k)}, {_say(v)})" for k, v in licenses.NOTICES.items())
    return f"""WITH n AS (SELECT license, {words('text')} AS w FROM (VALUES {notices}) v(license, text)), d AS (SELECT doc_id, {words('text')} AS w FROM documents),
        t AS (SELECT DISTINCT license, unnest({_shingles('w')}) AS s FROM n WHERE len(w) >= 5), size AS (SELECT license, count(*) AS n FROM t GROUP BY 1),
        e AS (SELECT DISTINCT doc_id, unnest({_shingles('w')}) AS s FROM d WHERE len(w) >= 5), hit AS (SELECT doc_id, license, count(*) AS shared FROM e JOIN t USING (s) GROUP BY 1, 2)
        SELECT doc_id, license, shared::INT AS shared, n::INT AS template_shingles, shared / n::DOUBLE AS containment FROM hit JOIN size USING (license) WHERE 5 * shared >= 4 * n
        UNION ALL SELECT doc_id, license, 1, 1, 1.0 FROM d JOIN n ON len(n.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(n.w, ' ') || ' ')"""


def op2() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text')} AS w FROM documents), k AS (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM d),
        class AS (SELECT key, min(doc_id) AS text_id, count(*) AS n_copies, any_value(w) AS w FROM k GROUP BY key), s AS (SELECT DISTINCT text_id, unnest({_shingles('w')}) AS s FROM class),
        size AS (SELECT text_id, count(*) AS n FROM s GROUP BY 1), pair AS (SELECT a.text_id AS a, b.text_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.text_id <> b.text_id GROUP BY 1, 2),
        link AS (SELECT pair.a, pair.b FROM pair JOIN size x ON x.text_id = pair.a JOIN size y ON y.text_id = pair.b WHERE 5 * pair.n >= 4 * (x.n + y.n - pair.n)),
        reach AS (SELECT text_id, text_id AS root FROM class UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.text_id),
        least AS (SELECT text_id, min(root) AS class_id FROM reach GROUP BY 1), degree AS (SELECT a AS text_id, count(*) AS n_links FROM link GROUP BY 1)
        SELECT k.doc_id, class_id, class.text_id, n_copies, coalesce(n_links, 0) AS n_links FROM k JOIN class USING (key) JOIN least USING (text_id) LEFT JOIN degree USING (text_id)"""


def op4() -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({vector_search.SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {vector_search.K}"""


def op6() -> str:
    return f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
        q AS (SELECT DISTINCT item_id, unnest({_shingles('w')}) AS s FROM i WHERE len(w) >= 5), size AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), e AS (SELECT DISTINCT doc_id, unnest({_shingles('w')}) AS s FROM d),
        hit AS (SELECT doc_id, item_id, count(*) AS shared FROM e JOIN q USING (s) GROUP BY 1, 2)
        SELECT doc_id, item_id, shared::INT AS shared, n::INT AS item_shingles, shared / n::DOUBLE AS containment FROM hit JOIN size USING (item_id) WHERE 5 * shared >= 4 * n
        UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM d JOIN i ON len(i.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')"""


#: kind -> (pattern of what may stand before it, pattern, the least length of the second group); ADDED patterns look
#: behind, which this engine's expressions cannot: the character before is matched as well and taken off.
_BEFORE = {"jwt": "[^A-Za-z0-9_-]", "github": "[^A-Za-z0-9]", "slack": "[^A-Za-z0-9]", "google": "[^A-Za-z0-9]"}
_SECRETS = {
    "assign": (None, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (None, "()(AKIA[A-Z0-9]+)", 20),
    "hex": (None, "()([0-9a-f]{24,})", 24),  # runs are maximal either way
} | {k: (_BEFORE.get(k), p.pattern.split(")", 1)[1] if k in _BEFORE else p.pattern, 0) for k, (_, p) in secrets.ADDED.items()}


def op8() -> str:
    """Positions from the pieces between the matches of each kind."""
    parts = []
    for order, (kind, (before, pattern, least)) in enumerate(_SECRETS.items()):
        p = _say(f"(^|{before}){pattern}" if before else pattern)
        skip = f"regexp_extract_all(t, {p}, 1)" if before else "list_transform(m, lambda x: '')"
        length = f"list_transform(regexp_extract_all(t, {p}, 2), lambda x: length(x))" if least else "list_transform(m, lambda x: 0)"
        sizes = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
        at = f"{{'s': {sizes('sp[1:i]')} + {sizes('m[1:i - 1]')} + length(pre[i]), 'e': {sizes('sp[1:i]')} + {sizes('m[1:i]')}, 'n': g[i]}}"
        parts.append(f"SELECT rid, {order} AS o, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {at})) AS v FROM (SELECT *, {skip} AS pre, {length} AS g FROM (SELECT rid, t, regexp_extract_all(t, {p}) AS m, regexp_split_to_array(t, {p}) AS sp FROM d)) WHERE len(m) > 0")
        parts[-1] = f"SELECT rid, o, kind, v.s::BIGINT AS s, v.e::BIGINT AS e FROM ({parts[-1]}) WHERE v.n >= {least}"
    n = lambda k: f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}"
    say = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)})
        SELECT doc_id, sha256(any_value(t)) AS blob, {n('assign')}, {n('access')}, {n('hex')}, sha256(coalesce(string_agg({say}, ',' ORDER BY s, o) FILTER (WHERE o < 3), '')) AS base_sha256, coalesce(string_agg({say}, ',' ORDER BY s, o, e), '') AS spans
        FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""


def op9() -> str:
    """The schedule slot by slot: a source may run when its next block is released, and the earliest deadline runs. A
    period is K slots; in it a source that has no block left leaves its slots out."""
    shares = ", ".join(f"({_say(k)}, {v})" for k, v in mixing.SHARES.items())
    name = f"CASE WHEN coalesce(source, '') IN ({', '.join(map(_say, mixing.SHARES))}) THEN source ELSE '{mixing.OTHER}' END"
    said = ", ".join(f"""'"{k}":' || CASE WHEN {k} IS NOT NULL THEN to_json({k})::VARCHAR END""" for k in ("doc_id", "text", "lang", "source", "n_chars"))
    digest = f"""md5('{{' || concat_ws(',', {said}) || '}}')"""
    return f"""WITH RECURSIVE share AS (SELECT * FROM (VALUES {shares}, ('{mixing.OTHER}', 1)) s(stream, w)),
        r AS (SELECT doc_id, source, {name} AS stream, {digest} AS h FROM documents), b AS (SELECT *, ('0x' || h[1:8])::BIGINT % greatest(1, ceil((SELECT count(*) FROM documents) / {mixing.BUCKET_ROWS}.0)::BIGINT) AS bucket FROM r),
        n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bucket, h, doc_id) - 1 AS i FROM b),
        live AS (SELECT list(stream ORDER BY stream) AS names, list(w ORDER BY stream) AS w, list(blocks ORDER BY stream) AS blocks FROM (SELECT stream, w, count(*) // {mixing.BLOCK_ROWS} + (count(*) % {mixing.BLOCK_ROWS} > 0)::INT AS blocks FROM n JOIN share USING (stream) GROUP BY 1, 2)),
        run AS (SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS served, list_transform(w, lambda x: 0::BIGINT) AS done, 0::BIGINT AS phase, list_transform(w, lambda x: true) AS on_, list_sum(w)::BIGINT AS k, NULL::BIGINT AS pick, NULL::BIGINT AS block, -1::BIGINT AS slot, NULL::BIGINT AS at_phase FROM live
          UNION ALL SELECT CASE WHEN last THEN 0 ELSE t + 1 END, CASE WHEN last THEN list_transform(served, lambda x: 0::BIGINT) ELSE served END, done, phase + (last AND stay <> on_)::INT, CASE WHEN last THEN stay ELSE on_ END,
            CASE WHEN last THEN list_sum(list_transform(w, lambda x, i: CASE WHEN stay[i] THEN x ELSE 0 END))::BIGINT ELSE k END, pick, CASE WHEN used THEN block END, slot + used::INT, phase
          FROM (SELECT *, t + 1 = k AS last, list_transform(blocks, lambda x, i: on_[i] AND done[i] < x) AS stay FROM (
            SELECT t, k, w, blocks, phase, on_, slot, pick, done[pick] AS block, done[pick] < blocks[pick] AS used, list_transform(served, lambda x, i: x + (i = pick)::INT) AS served, list_transform(done, lambda x, i: CASE WHEN i = pick AND x < blocks[i] THEN x + 1 ELSE x END) AS done FROM (
              SELECT run.*, live.w, live.blocks, list_min(list_transform(live.w, lambda x, i: CASE WHEN on_[i] AND served[i] < x AND served[i] * k // x <= t THEN {{'due': ((served[i] + 1) * k + x - 1) // x, 'i': i::BIGINT}} END)).i AS pick FROM (SELECT * EXCLUDE (pick, block, at_phase) FROM run) run, live WHERE list_bool_or(on_)) a) c) e),
        slots AS (SELECT live.names[pick] AS stream, block, slot, at_phase FROM run, live WHERE block IS NOT NULL)
        SELECT doc_id, source, i // {mixing.BLOCK_ROWS} AS mix_block, at_phase AS mix_phase, slot AS mix_slot, i % {mixing.BLOCK_ROWS} AS mix_row FROM n JOIN slots ON slots.stream = n.stream AND slots.block = n.i // {mixing.BLOCK_ROWS}"""


def op11() -> str:
    """Every document through every order, one filter after the other; no inclusion-exclusion."""
    return r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
            CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM d JOIN e USING (t) LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        r AS (SELECT g.*, filter_order, coalesce(list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i]))), 6) AS gone FROM g, o),
        s AS (SELECT part, filter_order[gone] AS letter, sum(n) AS shapley FROM r WHERE gone < 6 GROUP BY 1, 2),
        k AS (SELECT part, filter_order, step, filter_order[step] AS letter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN contains(fails, filter_order[step]) AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN gone = step THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN n * bad ELSE 0 END) AS toxic_lost FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
        FROM k LEFT JOIN s USING (part, letter)"""


def op13() -> str:
    """Every document scored for every item."""
    terms = lambda text: f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {terms('text')} AS w FROM documents), i AS (SELECT item_id, {terms('text')} AS w FROM benchmark),
        z AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
        wt AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, z GROUP BY term, nn),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score FROM q JOIN wt USING (term) JOIN tf USING (term), z GROUP BY 1, 2),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    own = (op1, op2, op4, op6, op8, op9, op11, op13)
    names = ("op1_license_scan", "op2_jaccard_join", "op4_vector_search", "op6_decontamination", "op8_secret_scan", "op9_source_mixing", "op11_filter_audit", "op13_lexical_search")
    return {name: sql() for name, sql in zip(names, own, strict=True)}
