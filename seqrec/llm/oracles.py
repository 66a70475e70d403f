"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from seqrec.llm.license_scan import CONTAINMENT, NOTICES, SHINGLE
from seqrec.llm.mixing import MOST, SEED, SHARE
from seqrec.llm.quality_rules import MATERIAL, PRIOR_SDS, STRONGEST, SURE_SDS, WEAKEST

BLANK_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LETTER_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    rows = ", ".join(f"({quoted(name)}, {quoted(f'{name}#{i}')}, {quoted(text)})" for name, texts in NOTICES.items() for i, text in enumerate(texts))

    def shingled(src: str, keys: str) -> str:
        return f"""SELECT {keys}, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(len(w) - {SHINGLE - 1}), lambda i: {{'p': i, 's': array_to_string(w[i + 1:i + {SHINGLE}], ' ')}})
            WHEN len(w) > 0 THEN [{{'p': 0, 's': 'short ' || array_to_string(w, ' ')}}] ELSE [] END) AS g FROM {src}"""

    return f"""
    WITH t AS (SELECT license, template, {LETTER_WORDS} AS w FROM (VALUES {rows}) v(license, template, text)),
    ts AS (SELECT DISTINCT license, template, g.s AS s FROM ({shingled('t', 'license, template')})),
    tn AS (SELECT license, template, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS scale FROM ts GROUP BY ALL),
    d AS (SELECT doc_id, {LETTER_WORDS} AS w FROM documents),
    ds AS (SELECT doc_id, g.p AS p, g.s AS s FROM ({shingled('d', 'doc_id')})),
    hit AS (SELECT doc_id, license, template, n, s, unnest([p // scale, p // scale - 1]) AS win FROM ds JOIN ts USING (s) JOIN tn USING (license, template)),
    share AS (SELECT doc_id, license, template, count(DISTINCT s) / max(n) AS c FROM hit WHERE win >= 0 GROUP BY doc_id, license, template, win),
    best AS (SELECT doc_id, license, template, max(c) AS c FROM share WHERE c >= {CONTAINMENT} - 1e-9 GROUP BY ALL),
    agg AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(c) AS c FROM best GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, round(coalesce(c, 0.0), 6) AS best_containment
    FROM d LEFT JOIN agg USING (doc_id)"""


MIX = f"""
    WITH d AS (SELECT doc_id, source, CAST(len({BLANK_WORDS}) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, {MOST}::DOUBLE * source_size AS cap FROM s),
    f AS (SELECT *, cap / weight AS fills FROM r),
    u AS (SELECT *, sum(cap) OVER w AS capped, sum(weight) OVER () - sum(weight) OVER w AS rest, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM f WINDOW w AS (ORDER BY fills RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, capped + fills * rest <= total AS filled FROM u),
    l AS (SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER () AS done, sum(CASE WHEN NOT filled THEN weight END) OVER () AS open FROM g),
    t AS (SELECT source, source_size, least(CASE WHEN filled THEN cap ELSE (total - done) * weight / open END, cap) AS target FROM l),
    x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / {float(1 << 52)} AS draw
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x"""

CHAT = """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    o AS (SELECT *, length(replace(text, '\\', '\\\\')) + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
    v AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k), '') AS before FROM o)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(5 + length(role) + length(role) - length(replace(role, ':', '')) + 2 + chars + 8) AS BIGINT) AS formatted_chars,
        bool_and((role = 'system' AND k = 1) OR (role = 'user' AND (k = 1 OR before IN ('system', 'assistant'))) OR (role = 'assistant' AND before = 'user')) AND arg_max(role, k) = 'assistant' AS valid
    FROM v GROUP BY conv_id"""

HOSTS = f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {BLANK_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 't': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM d),
    h AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.t) AS c FROM g),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    b AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
    s AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f GROUP BY source),
    o AS (SELECT *, x / n AS r, (sum(x) OVER () - x) / nullif(sum(n) OVER () - n, 0) AS m, nullif(count(*) OVER () - 1, 0) AS h, sum(x / n) OVER () - x / n AS r1,
        sum((x / n) * (x / n)) OVER () - (x / n) * (x / n) AS r2, sum(1 / n) OVER () - 1 / n AS inv FROM s),
    v AS (SELECT *, r2 / h - 2 * m * r1 / h + m * m - m * (1 - m) * inv / h AS v FROM o),
    k AS (SELECT source, n, x, m AS others, coalesce(m, r) AS m, coalesce(least(greatest(m * (1 - m) / greatest(v, 1e-9) - 1, {WEAKEST}), {STRONGEST}), {WEAKEST}) AS s FROM v),
    z AS (SELECT source, others, (x + m * s) / (n + s) AS p, n + s + 1 AS size, least(m + greatest({PRIOR_SDS} * sqrt(m * (1 - m) / (s + 1)), {MATERIAL}), (1 + m) / 2) AS most FROM k),
    j AS (SELECT source, others IS NULL OR p - {SURE_SDS} * sqrt(p * (1 - p) / size) <= most AS fine FROM z)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source"""

LEAKS = f"""
    WITH d AS (SELECT doc_id, {LETTER_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {LETTER_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(greatest(len(w) - 9, least(len(w), 1))), lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS s FROM b),
    size AS (SELECT DISTINCT m FROM win),
    dw AS (SELECT doc_id, m, unnest(list_transform(range(greatest(len(w) - m + 1, 0)), lambda i: {{'p': i, 's': array_to_string(w[i + 1:i + m], ' ')}})) AS g FROM d, size),
    hit AS (SELECT doc_id, g.p AS p, m, item_id FROM dw JOIN win USING (m) WHERE g.s = win.s),
    n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
    i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

ORACLES = {"op1_license_scan": _license_sql(), "op2_source_mix": MIX, "op3_chat_format": CHAT, "op6_decontaminate": LEAKS, "op10_host_rules": HOSTS}
