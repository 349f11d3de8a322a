"""SQL for DuckDB that says the same as the longer queries, built from parts."""

from __future__ import annotations

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """Unsigned checksum of an ASCII text: one list element a bit, the byte in the first of eight."""
    mixed = "CASE WHEN x >= 0 THEN xor(c, x) ELSE c END"
    step = f"CASE WHEN ({mixed}) & 1 = 1 THEN xor(({mixed}) >> 1, 3988292384) ELSE ({mixed}) >> 1 END"
    bits = f"list_transform(string_split({text}, ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1])"
    bytes_ = f"list_concat([CAST(4294967295 AS BIGINT)], flatten({bits}))"
    return f"xor(list_reduce({bytes_}, lambda c, x: {step}), 4294967295)"


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _tree(first: str, levels: int, name: str) -> list[str]:
    """CTEs {name}0.. of nodes (g, i, h, n) and {name}s0.. of their siblings (g, i, n, b, a)."""
    out = [f"{name}0 AS ({first})"]
    for level in range(levels):
        here = f"{name}{level}"
        out.append(
            f"{name}s{level} AS (SELECT g, i, n, array_to_string(run[1:i % 8], '') AS b, "
            f"array_to_string(run[i % 8 + 2:8], '') AS a FROM (SELECT g, i, n, list(h) OVER (PARTITION BY g, i // 8 "
            f"ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {here}))"
        )
        out.append(
            f"{name}{level + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) "
            f"ELSE max(h) END AS h, (max(n) + 7) // 8 AS n FROM {here} GROUP BY g, i // 8)"
        )
    return out


def merkle(levels: int = 7, above: int = 3) -> str:
    """Trees of up to 8 ** levels leaves a language and 8 ** above languages."""
    changed = f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(ASCII_LOWER.format('text'))} ELSE {_leaf('text')} END"
    ctes = [
        f"d AS (SELECT doc_id, {_leaf('text')} AS leaf, {changed} AS f0, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g "
        "FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
    ]
    ctes += _tree("SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p", levels, "l")
    ctes += _tree(
        f"SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM l{levels}", above, "t"
    )
    rows = "SELECT p.*, '' AS proof FROM p"
    for level in range(levels + above):
        low = level < levels
        siblings = f"ls{level} s ON s.g = r.g AND s.i = r.i // {8**level}"
        siblings = siblings if low else f"ts{level - levels} s ON s.i = r.g // {8 ** (level - levels)}"
        fold = f"CASE WHEN s.n > 1 THEN sha256(s.b || f{level} || s.a) ELSE f{level} END"
        rows = (
            f"SELECT r.* EXCLUDE (f{level}, proof), {fold} AS f{level + 1}, r.proof || s.b || s.a AS proof "
            f"FROM ({rows}) r JOIN {siblings}"
        )
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT r.doc_id, r.leaf, l.h AS subroot, t.h AS root, sha256(r.proof) AS proof_sha256, "
        f"f{levels + above} AS folded_root, f{levels + above} = t.h AS verified FROM ({rows}) r JOIN l{levels} l ON l.g = r.g "
        f"CROSS JOIN t{above} t"
    )


def _edit(state: str, cost: str, letter: str) -> str:
    """A state's text is nine digits of cost, then the audit, so the least text is the best way."""
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}'"


def repair() -> str:
    """Damage, faults and a forward DP over a conversation's rows, by list folds."""
    fate = crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + " % 20"
    cut, none, s = "3 * r.cut", "CAST(NULL AS VARCHAR)", "c.v[{}]".format
    when = lambda test, then: f"CASE WHEN {test} THEN {then} END"
    user_from = [s(1), s(2), s(4)]
    kept_user = [when("NOT r.gone AND r.role = 'u'", _edit(x, cut, "K")) for x in user_from]
    given_user = [when("NOT r.gone", _edit(x, f"3 + {cut}", "R")) for x in user_from]
    start = _edit(s(1), "4", "D")
    system = f"least({_edit(s(2), '4', 'D')}, {when("NOT r.gone AND r.role = 's'", _edit(s(1), cut, 'K'))})"
    user = f"least({', '.join([_edit(s(3), '4', 'D'), *kept_user, *given_user])})"
    assistant = (
        f"least({_edit(s(4), '4', 'D')}, {when("NOT r.gone AND r.role = 'a'", _edit(s(3), cut, 'K'))}, "
        f"{when('NOT r.gone', _edit(s(3), f'3 + {cut}', 'R'))})"
    )
    # Insertions follow the row: a user's after any other state, an assistant's after a user's.
    opened = f"list_transform([[{start}, {system}, {user}, {assistant}]], lambda w: [w[1], w[2], least(w[3], " + ", ".join(
        _edit(f"w[{k}]", "3", "I") for k in (1, 2, 4)
    ) + "), w[4]])[1]"
    closed = f"list_transform([{opened}], lambda w: [w[1], w[2], w[3], least(w[4], {_edit('w[3]', '3', 'I')})])[1]"
    first = f"['000000000', {none}, '000000003I', '000000006II']"
    new = "CASE WHEN c.st = 'u' THEN 'a' ELSE 'u' END"
    name = f"CASE WHEN ({new}) = 'u' THEN 'user' ELSE 'assistant' END"
    return f"""
WITH hurt AS (
  SELECT conv_id, turn, fate, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {fate} AS fate FROM conversations)),
kept AS (
  SELECT conv_id, turn, role, text FROM hurt WHERE fate <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE fate = 3),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM kept),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS unended FROM placed),
faults AS (
  SELECT *, NOT blank AND again > 1 AS duplicate, NOT blank AND again = 1 AND unended AS truncated FROM seen),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'v': {first}, 'role': left(role, 1), 'gone': blank OR duplicate, 'cut': CAST(truncated AS INTEGER)}} ORDER BY p) AS steps,
    list({{'role': role, 'text': text}} ORDER BY p) AS turns
  FROM faults GROUP BY conv_id),
solved AS (
  SELECT *, list_reduce(list_concat([{{'v': {first}, 'role': '', 'gone': false, 'cut': 0}}], steps),
    lambda c, r: {{'v': {closed}, 'role': '', 'gone': false, 'cut': 0}}).v AS ways FROM convs),
chosen AS (SELECT *, least(ways[1], ways[4]) AS best FROM solved),
spelled AS (
  SELECT *, substr(best, 10) AS audit, list_reduce(list_concat([{{'e': '', 'at': 1, 'st': '', 'out': CAST([] AS VARCHAR[])}}],
    list_transform(string_split(substr(best, 10), ''), lambda e: {{'e': e, 'at': 1, 'st': '', 'out': CAST([] AS VARCHAR[])}})),
    lambda c, r: CASE r.e
      WHEN 'D' THEN {{'e': '', 'at': c.at + 1, 'st': c.st, 'out': c.out}}
      WHEN 'K' THEN {{'e': '', 'at': c.at + 1, 'st': left(turns[c.at].role, 1),
                     'out': list_append(c.out, turns[c.at].role || ':' || turns[c.at].text)}}
      WHEN 'R' THEN {{'e': '', 'at': c.at + 1, 'st': {new}, 'out': list_append(c.out, {name} || ':' || turns[c.at].text)}}
      WHEN 'I' THEN {{'e': '', 'at': c.at, 'st': {new}, 'out': list_append(c.out, {name} || ':')}}
      ELSE c END).out AS lines FROM chosen)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN spelled s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
"""
