"""SQL that gives the same rows as queries of this package, for checking."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: the engine that runs the checks has no such function."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii(substr({text}, i, 1)) >> j) & 1)))"
    step = "lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda b: b::BIGINT)), {step}), 4294967295)"


def _leaf(n_chars: str) -> str:
    part = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Levels by repeated grouping of pairs, then a climb with one sibling at a time.
MERKLE = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
lower_levels AS (
  SELECT lang, 0 AS lv, place, leaf AS hash, n FROM placed
  UNION ALL
  SELECT lang, lv + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), any_value(n + 1) // 2
  FROM lower_levels WHERE n > 1 GROUP BY lang, lv, place // 2),
subroots AS (
  SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
upper_levels AS (
  SELECT 0 AS lv, place, hash, n FROM subroots
  UNION ALL
  SELECT lv + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), any_value(n + 1) // 2
  FROM upper_levels WHERE n > 1 GROUP BY lv, place // 2),
inner_climb AS (
  SELECT doc_id, leaf, lang, 0 AS lv, place, n, coalesce(changed, leaf) AS fold, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.lv + 1, c.place // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN s.hash || c.fold ELSE c.fold || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM inner_climb c LEFT JOIN lower_levels s ON s.lang IS NOT DISTINCT FROM c.lang AND s.lv = c.lv AND s.place = xor(c.place, 1)
  WHERE c.n > 1),
outer_climb AS (
  SELECT c.doc_id, c.leaf, s.hash AS subroot, 0 AS lv, s.place, s.n, c.fold, c.proof
  FROM inner_climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lv + 1, c.place // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN s.hash || c.fold ELSE c.fold || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM outer_climb c LEFT JOIN upper_levels s ON s.lv = c.lv AND s.place = xor(c.place, 1)
  WHERE c.n > 1)
SELECT c.doc_id, c.leaf, c.subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = r.hash AS verified
FROM outer_climb c, (SELECT hash FROM upper_levels WHERE n = 1) r
WHERE c.n = 1
"""


def _with(state: str, edit: str, cost: str, turn: str | None) -> str:
    said = f"list_append({state}.said, {turn})" if turn else f"{state}.said"
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', 'said': {said}}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _inserted(source: str, more: str = "") -> str:
    """States after any inserted turns: a user turn after any state but itself, an assistant turn after a user turn."""
    ways = (_with(x, "I", "5", "'user:'") for x in "esa")
    user = f"SELECT {more} e, s, {_least('u', *ways)} AS u, a FROM {source}"
    return f"SELECT {more} e, s, u, {_least('a', _with('u', 'I', '5', "'assistant:'"))} AS a FROM ({user})"


def _row_step() -> str:
    stays, late = "fault IS NULL OR fault = 'truncated'", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    when = lambda test, way: f"CASE WHEN ({stays}){test} THEN {way} END"
    keep = lambda x, initial: when(f" AND role[1] = '{initial}'", _with(x, "K", late, "role || ':' || text"))
    rerole = lambda x, to: when("", _with(x, "R", f"1 + {late}", f"'{to}:' || text"))
    gone = lambda x: _with(x, "D", "2", None)
    user = [way for x in "esa" for way in (keep(x, "u"), rerole(x, "user"))]
    return (
        f"{gone('e')} AS e, {_least(gone('s'), keep('e', 's'))} AS s, {_least(gone('u'), *user)} AS u, "
        f"{_least(gone('a'), keep('u', 'a'), rerole('u', 'assistant'))} AS a"
    )


_NONE = "{'cost': 1000000000, 'audit': '', 'said': []::VARCHAR[]}"

#: Row by row with the best way into each of four states; ways compare by price, then by their strings of edits.
REPAIR = f"""
WITH RECURSIVE
damage AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
kept AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, t.k
  FROM damage, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(k)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i FROM kept),
judged AS (
  SELECT conv_id, turn, role, text, i,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM numbered),
told AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(i) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id),
search AS (
  SELECT conv_id, 0 AS taken, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS e, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM told
  UNION ALL
  SELECT x.conv_id, x.taken + 1, {_row_step()}
  FROM ({_inserted("search", "conv_id, taken,")}) x JOIN judged j ON j.conv_id IS NOT DISTINCT FROM x.conv_id AND j.i = x.taken + 1)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(array_to_string(best.said, chr(10))) AS repaired_sha256, len(best.said)::BIGINT AS n_turns
FROM (SELECT t.*, {_least("f.e", "f.a")} AS best
  FROM told t JOIN ({_inserted("search", "conv_id, taken,")}) f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.taken = t.n)
"""
