"""DuckDB SQL for the queries that SQL can express, on the same tables.

The others have no SQL: op1 links parts with look-around patterns, op2 trains trees, op5 weighs by
logarithms of counts, op7 merges byte pairs, op8 aligns sequences. Tests hold them against brute
force.
"""

from __future__ import annotations

import re

from . import chat, decontam, mixing, quality

_SPACE = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _op3() -> str:
    marks = "|".join([r"\\", *(re.escape(c) for c in chat.CONTROL)])
    around = len(chat.OPEN) + len(chat.CLOSE) + 1
    return f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        whole AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum({around} + length(role) + length(text)
                       + len(regexp_extract_all(text, {_text(marks)}))) AS chars
            FROM rows GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
        FROM whole"""


def _op4() -> str:
    return f"""
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w
            FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') FROM benchmark),
        runs AS (
            SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
            FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
        items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM runs WHERE kind = 'b')
        SELECT d.id AS doc_id, b.id AS item_id, count(*)::DOUBLE / max(n) AS containment
        FROM items b JOIN runs d ON d.kind = 'd' AND d.s = b.s
        GROUP BY d.id, b.id HAVING count(*) >= {decontam.CONTAINED} * max(n) - 1e-9"""


OP11 = r"""
    WITH RECURSIVE
    given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
        FROM conversations),
    crc AS (
        SELECT key, xor(list_reduce(list_concat([4294967295],
                   flatten(list_transform(string_split(key, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384)
                                     ELSE x // 2 END), 4294967295) % 20 AS dealt
        FROM (SELECT DISTINCT key FROM given)),
    faulty AS (
        SELECT conv_id, turn, CASE dealt WHEN 4 THEN 'user' ELSE role END AS role,
               CASE dealt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE dealt WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM given JOIN crc USING (key)),
    marked AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               left(role, 1) AS c,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
               NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
               NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
        FROM faulty),
    placed AS (
        SELECT *, again OR blank AS must, (open AND NOT again AND NOT blank)::INT AS cut,
               lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked),
    follows AS (SELECT * FROM (VALUES ('', 'u'), ('', 's'), ('s', 'u'), ('u', 'a'), ('a', 'u')) AS t(st, c)),
    added AS (SELECT st, c FROM follows WHERE c != 's'),
    inserts AS (
        SELECT st, st AS after, 0 AS paid, '' AS did, '' AS said FROM added
        UNION ALL SELECT st, c, 2, 'I', chr(10) || CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END FROM added
        UNION ALL
        SELECT x.st, y.c, 4, 'II', chr(10) || CASE x.c WHEN 'u' THEN 'user:' || chr(10) || 'assistant:'
                                               ELSE 'assistant:' || chr(10) || 'user:' END
        FROM added x JOIN added y ON y.st = x.c),
    steps AS (
        SELECT conv_id, i, st, st AS after, 3 AS paid, 'D' AS did, '' AS said FROM placed, added
        UNION ALL
        SELECT conv_id, i, st, f.c, cut, 'K', chr(10) || role || ':' || text
        FROM placed p JOIN follows f ON f.c = p.c WHERE NOT must
        UNION ALL
        SELECT conv_id, i, st, a.c, 2 + cut, 'R',
               chr(10) || CASE a.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
        FROM placed p, added a WHERE NOT must),
    walk AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, 0 AS cost, '' AS audit, '' AS fixed FROM given
        UNION ALL
        SELECT conv_id, i, st, cost, audit, fixed FROM (
            SELECT w.conv_id, s.i, s.after AS st, w.cost + n.paid + s.paid AS cost, w.audit || n.did || s.did AS audit,
                   w.fixed || n.said || s.said AS fixed,
                   row_number() OVER (PARTITION BY w.conv_id, s.after
                                      ORDER BY w.cost + n.paid + s.paid, w.audit || n.did || s.did) AS nth
            FROM walk w JOIN inserts n ON n.st = w.st
            JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.st = n.after)
        WHERE nth = 1),
    ended AS (
        SELECT w.conv_id, w.cost + n.paid AS cost, audit || did AS audit, substr(fixed || said, 2) AS fixed
        FROM walk w JOIN inserts n ON n.st = w.st
        LEFT JOIN (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id
        WHERE w.i = coalesce(m.n, 0) AND n.after IN ('', 'a')
        QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.paid, audit || did) = 1),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
               sum(cut) AS truncated,
               count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
        FROM placed GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(fixed) AS repaired_sha256
    FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


OP6 = """
    WITH sized AS (
        SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    kept AS (SELECT html, max(page_id) AS response FROM sized WHERE n >= 1000 GROUP BY html)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(sized.html) AS payload_digest,
           CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN response <> page_id THEN response END AS refers_to
    FROM sized LEFT JOIN kept ON sized.html = kept.html AND n >= 1000"""


def _op9() -> str:
    draws = ", ".join(f"({i}, {u!r}::DOUBLE)" for i, u in enumerate(mixing.offsets()))
    first, *others = mixing.WEIGHTS
    n = len(mixing.WEIGHTS)
    weight = " ".join(f"WHEN rank % {n} = {i + 1} THEN {w}" for i, w in enumerate(others))
    return f"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS size FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
        weighed AS (SELECT *, CASE {weight} ELSE {first} END AS weight, {mixing.MOST} * source_size AS cap FROM sources),
        stepped AS (
            SELECT *, ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS each
            FROM weighed
            WINDOW earlier AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (
            SELECT arg_min(each, (cap::DOUBLE / weight, rank)) AS level FROM stepped WHERE each * weight < cap),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN each * weight >= cap THEN cap::DOUBLE ELSE level * weight END AS target
            FROM stepped LEFT JOIN level ON true),
        placed AS (
            SELECT doc_id, size, s.source, source_size, target,
                   CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS FIRST) AS place
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        draws(i, u) AS (VALUES {draws}),
        tried AS (
            SELECT source, i, u, abs(sum((floor(place * rate + u) - floor((place - 1) * rate + u)) * size) - max(target)) AS off
            FROM placed, draws GROUP BY source, i, u),
        chosen AS (SELECT source, arg_min(u, (off, i)) AS u FROM tried GROUP BY source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST((floor(place * rate + u) - floor((place - 1) * rate + u)) * size AS BIGINT) AS taken
        FROM placed p JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source"""


def _op10() -> str:
    separators = ", ".join(_text(s) for s in sorted(quality.SEPARATORS))
    hung = r"(?:[#*$%&<>~^=_]{2,}|!{2,})(?:[\x20\x09-\x0D]|$)"
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        counted AS (
            SELECT *, regexp_extract_all(text, '{_SPACE}') AS w FROM docs),
        windows AS (
            SELECT r, i, array_to_string(w[i : i + 2], ' ') AS s
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM counted)),
        twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
        repeated AS (
            SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS steps(k) GROUP BY r),
        lines AS (
            SELECT r, line, len(regexp_extract_all(line, '{_SPACE}')) AS n,
                   len(list_filter(regexp_extract_all(line, '{_SPACE}'), lambda x: x IN ({separators}))) AS seps,
                   len(regexp_extract_all(line, {_text(hung)})) AS hung
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
        judged AS (
            SELECT r, count(*) - count(DISTINCT line) AS dup,
                   sum(CASE WHEN (seps >= 3 AND 4 * seps >= n - seps) OR 10 * hung >= 3 * n
                             OR (n <= {quality.STOCK_WORDS} AND regexp_matches(line, {_text('(?i)' + quality.STOCK.pattern)}))
                       THEN n ELSE 0 END) AS lost
            FROM lines WHERE n > 0 GROUP BY r),
        all_ AS (
            SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
                   coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words
            FROM counted LEFT JOIN repeated USING (r) LEFT JOIN judged USING (r)),
        base AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM all_)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
               CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lost_words AS BIGINT) AS n_lost_words, base_failed,
               NOT base_failed AND n_lost_words <= {quality.MAX_LOSS} * n_words AS kept
        FROM base"""


SQL: dict[str, str] = {
    "op3_chat_formatting": _op3(),
    "op4_benchmark_decontamination": _op4(),
    "op6_warc": OP6,
    "op9_mixing": _op9(),
    "op10_quality_rules": _op10(),
    "op11_structure_repair": OP11,
}
