"""DuckDB SQL of the queries over conversations and of the manifest: the same rows by plain means."""

from __future__ import annotations

#: crc32 by a table of its bytes' remainders; 3988292384 is the fixed polynomial.
CRC_TABLE = """remainders(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM remainders WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM remainders WHERE k = 8)"""


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text; ``crc_table`` must be among the tables."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(4294967295, list_reduce({codes}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT))"


# Conversations: costs and edits of what is left, backward over the rows, for each state of the grammar.


def option(cost: str, letter: str, line: str, state: str) -> str:
    """An edit before what ``state`` has: cost, audit, lines."""
    return f"{{'c': {cost} + {state}.c, 't': '{letter}' || {state}.t, 'o': {line} || {state}.o}}"


def least(*options: str) -> str:
    """The least option by cost, then audit."""
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def over_row(state: str, follows: str, keeps: str) -> str:
    """The best edit of the row itself in a state."""
    cut, stays, line = "(fault = 2)::BIGINT", "fault >= 2", "[role || ':' || text]"
    role = "assistant" if follows == "a" else "user"
    named = "[" + f"'{role}:' || text" + "]"
    kept = f"CASE WHEN {stays} AND r = '{{0}}' THEN {option(cut, 'K', line, '{1}')} END"
    # Braces of the struct stand in the text, so that states are put in by hand.
    kept = [kept.replace("{0}", letter).replace("{1}", letter) for letter in keeps]
    return least(option("3", "D", "[]::VARCHAR[]", state), f"CASE WHEN {stays} THEN {option('2 + ' + cut, 'R', named, follows)} END", *kept)


USER, ASSISTANT = "['user:']", "['assistant:']"
CONVERSATIONS = f"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE damage <> 0),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending
  FROM damaged),
faulty AS MATERIALIZED (
  SELECT *, left(role, 1) AS r, CASE WHEN ending = '' THEN 0 WHEN again THEN 1 WHEN ending NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered),
dp(c, i, n, s, u, a) AS (
  SELECT c, max(i) + 1, {{'c': 0::BIGINT, 't': '', 'o': []::VARCHAR[]}}, {{'c': 4::BIGINT, 't': 'II', 'o': ['user:', 'assistant:']}}, {{'c': 2::BIGINT, 't': 'I', 'o': ['assistant:']}}, {{'c': 0::BIGINT, 't': '', 'o': []::VARCHAR[]}} FROM faulty GROUP BY c
  UNION ALL
  SELECT c, i, {least("n", option("2", "I", USER, "u"), option("4", "II", "['user:', 'assistant:']", "a"))}, {least("s", option("2", "I", USER, "u"), option("4", "II", "['user:', 'assistant:']", "a"))},
         {least("u", option("2", "I", ASSISTANT, "a"))}, {least("a", option("2", "I", USER, "u"))}
  FROM (SELECT f.c, f.i, {over_row("n", "u", "su")} AS n, {over_row("s", "u", "u")} AS s, {over_row("u", "a", "a")} AS u, {over_row("a", "u", "u")} AS a
        FROM dp JOIN faulty f ON f.c = dp.c AND f.i = dp.i - 1)),
sums AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate,
         count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
found AS (SELECT sums.*, n.c AS cost, n.t AS audit, sha256(array_to_string(n.o, chr(10))) AS repaired_sha256 FROM sums JOIN dp USING (c) WHERE i = 1)
SELECT e.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))}, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN found f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""

# The manifest: levels are written out, 16^5 documents of a source and 16^3 sources.


def framed(column: str) -> str:
    """A field of a leaf."""
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def leaf(text: str) -> str:
    """A leaf with this text."""
    return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def levels(name: str, count: int) -> str:
    """Tables of runs (tree, run, d) and nodes (tree, i, w, d) above the table ``name``0."""
    out = []
    for k in range(count):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, i // 16 AS run, string_agg(d, '' ORDER BY i) AS d, any_value(w) AS w FROM {name}{k} WHERE w > 1 GROUP BY tree, i // 16)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, run AS i, (w + 15) // 16 AS w, sha256(d) AS d FROM {name}r{k} UNION ALL SELECT * FROM {name}{k} WHERE w = 1)")
    return ",\n".join(out)


def manifest(deep: int = 5, top: int = 3) -> str:
    """SQL of the query."""
    steps = [("n", k, "tree", "place") for k in range(deep)] + [("t", k, "0", "tree") for k in range(top)]
    joins = " ".join(f"LEFT JOIN {x}r{k} AS j{x}{k} ON j{x}{k}.tree = {'p.tree' if x == 'n' else '0'} AND j{x}{k}.run = p.{at} // {16 ** (k + 1)}" for x, k, _, at in steps)
    at = {(x, k): f"(p.{at} // {16**k} % 16 * 64)" for x, k, _, at in steps}
    sides = ", ".join(f"coalesce(substr(j{x}{k}.d, 1, {at[x, k]}), '') AS l{x}{k}, coalesce(substr(j{x}{k}.d, {at[x, k]} + 65), '') AS r{x}{k}, j{x}{k}.d IS NOT NULL AS h{x}{k}" for x, k, _, _ in steps)
    folds, last = "", "sided"
    for x, k, _, _ in steps:
        folds += f", f{x}{k} AS (SELECT * REPLACE (CASE WHEN h{x}{k} THEN sha256(l{x}{k} || folded || r{x}{k}) ELSE folded END AS folded) FROM {last})"
        last = f"f{x}{k}"
    return f"""
WITH RECURSIVE {CRC_TABLE},
made AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents, crc_table),
placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS w FROM made),
n0 AS (SELECT tree, place AS i, w, leaf AS d FROM placed), {levels("n", deep)},
t0 AS (SELECT 0 AS tree, tree AS i, (SELECT count(*) FROM n{deep}) AS w, d FROM n{deep}), {levels("t", top)},
sided AS (SELECT p.doc_id, p.leaf, s.d AS subroot, (SELECT d FROM t{top}) AS root, coalesce(p.tampered, p.leaf) AS folded, {sides} FROM placed p JOIN n{deep} s ON s.tree = p.tree {joins}){folds}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"l{x}{k} || r{x}{k}" for x, k, _, _ in steps)}) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}
"""
