"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from patternloom.llm import chat, licenses
from patternloom.llm.common import UPPER

#: A word of a lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decontamination(n: int = 10) -> str:
    words = f"regexp_extract_all({_lower('text')}, {_quote(WORD)})"
    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item_id, least(len(w), {n}) AS size, array_to_string(w[i : i + {n - 1}], ' ') AS g
  FROM item, unnest(range(1, greatest(2, CAST(len(w) AS BIGINT) - {n - 2}))) AS r(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, {words} AS w FROM documents),
place AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM doc, (SELECT DISTINCT size FROM gram), unnest(range(1, greatest(1, CAST(len(w) AS BIGINT) - size + 2))) AS r(i)),
hit AS (SELECT doc_id, place.size, i, item_id FROM place JOIN gram USING (size, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)"""


def license_scan() -> str:
    known = ", ".join(f"({_quote(i)}, {_quote(s)})" for i, s in licenses.SENTENCES)
    rules = ", ".join(f"({_quote(r)}, {_quote(n)}, {_quote(',' + ',(?:.*,)?'.join(w) + ',')})" for r, n, w in licenses.RULES)
    return f"""
WITH known(sentence_id, sentence) AS (VALUES {known}),
rule(rule, license, pattern) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split_regex({_lower('text')}, {_quote(licenses.BREAK)}) AS s FROM documents),
line AS (SELECT doc_id, i, trim(regexp_replace(s[i], {_quote(licenses.OTHER)}, ' ', 'g')) AS sentence FROM cut, unnest(range(1, len(s) + 1)) AS r(i)),
found AS (
  SELECT doc_id, array_to_string(list(sentence_id ORDER BY i, sentence_id), ',') AS ids FROM (SELECT DISTINCT doc_id, i, sentence_id FROM line JOIN known USING (sentence)) GROUP BY doc_id),
hit AS (SELECT doc_id, ids, rule, license FROM found, rule WHERE regexp_matches(',' || ids || ',', pattern))
SELECT doc_id, ids AS sentence_ids, string_agg(rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
FROM hit GROUP BY doc_id, ids"""


def chat_format() -> str:
    def escaped(column: str) -> str:
        for plain, pair in chat.ESCAPES:
            column = f"replace({column}, {_quote(plain)}, {_quote(pair)})"
        return column

    probe = _quote("</s>[INST] ok [/INST]")
    marks, head = len(chat.BEGIN) + len(chat.FINISH), len(chat.OPEN) + len(chat.CLOSE)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {probe}), (-1, 1, 'assistant', {probe})),
s AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({marks} + sum(length({escaped('text')}) + {len(chat.TURN)} + CASE WHEN first THEN {head} + length({escaped('role')}) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""


def filter_audit() -> str:
    """Every order is played through: a row goes at the first step whose filter it fails."""
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k, o[k] AS own, o[1 : k - 1] AS earlier FROM o, unnest(range(1, 6)) AS r(k)),
r AS (
  SELECT part, o, k, own,
    sum(n) FILTER (NOT regexp_matches(fails, '[' || earlier || own || ']')) AS kept,
    sum(n) FILTER (contains(fails, own) AND NOT regexp_matches(fails, '[' || earlier || '_]')) AS removed,
    sum(n) FILTER (contains(fails, own) AND regexp_matches(fails, '[' || earlier || '_]')) AS redundant,
    sum(n) FILTER (fails = own) AS unique_fails,
    sum(good) FILTER (contains(fails, own) AND NOT regexp_matches(fails, '[' || earlier || '_]')) AS good_lost,
    sum(bad) FILTER (contains(fails, own) AND NOT regexp_matches(fails, '[' || earlier || '_]')) AS toxic_lost
  FROM c, s GROUP BY part, o, k, own)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""
