"""DuckDB statement of the conversation repair: the dynamic program as a recursive query over all conversations at once."""

from __future__ import annotations

from tillscope.llm.repair import DELETE, INSERT, LEFT_TRUNCATED, NEXT, REROLE, ROLES

# crc32 by its polynomial, bit by bit; the text is a number, a colon and a number.
CRC = """xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(-1 AS BIGINT))),
      lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
EMPTY = "CAST([] AS VARCHAR[])"


def option(cost: str, audit: str, rows: str) -> str:
    return f"{{'cost': CAST({cost} AS BIGINT), 'audit': {audit}, 'rows': {rows}}}"


def plain(state: int) -> str:
    """The best edit of a row from a state, without inserts before it."""
    after = f"s{NEXT[state]}"
    role = ROLES[NEXT[state]]
    kept = {
        "s": "s1" if state == 0 else None,
        "u": "s2" if state != 2 else None,
        "a": "s3" if state == 2 else None,
        "": f"s{state}",
    }
    keep = " ".join(
        f"WHEN initial = '{i}' THEN {option(f'extra + {s}.cost', f'''{chr(39)}K{chr(39)} || {s}.audit''', f'''list_concat([role || ':' || text], {s}.rows)''')}"
        for i, s in kept.items()
        if s
    )
    delete = option(f"{DELETE} + s{state}.cost", f"'D' || s{state}.audit", f"s{state}.rows")
    rerole = option(f"{REROLE} + extra + {after}.cost", f"'R' || {after}.audit", f"list_concat(['{role}:' || text], {after}.rows)")
    return f"list_min(list_filter([{delete}, CASE WHEN must_go THEN NULL {keep} END, CASE WHEN NOT must_go THEN {rerole} END], lambda x: x IS NOT NULL))"


def inserted(state: int) -> str:
    """The best edits from a state, with up to three inserts first."""
    options, rows, at = [f"p{state}"], [], state
    for n in range(1, 4):
        at = NEXT[at]
        rows.append(f"'{ROLES[at]}:'")
        options.append(option(f"{n * INSERT} + p{at}.cost", f"'{'I' * n}' || p{at}.audit", f"list_concat([{', '.join(rows)}], p{at}.rows)"))
    return f"list_min([{', '.join(options)}])"


START = ", ".join(
    [
        option("0", "''", EMPTY) + " AS s0",
        option(str(2 * INSERT), "'II'", "['user:', 'assistant:']") + " AS s1",
        option(str(INSERT), "'I'", "['assistant:']") + " AS s2",
        option("0", "''", EMPTY) + " AS s3",
    ]
)

SQL = f"""
WITH RECURSIVE original AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS draw
  FROM conversations
), damaged AS (
  SELECT conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) FROM original WHERE draw <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS place, rtrim(text, {SPACE}) AS core,
    count(*) OVER (PARTITION BY conv) AS n
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN min(place) OVER (PARTITION BY conv, role, text) < place THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv ORDER BY place) AS before
  FROM placed
), marked AS MATERIALIZED (
  SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN {LEFT_TRUNCATED} ELSE 0 END AS extra FROM faulty
), counts AS (
  SELECT conv, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv
), best AS (
  SELECT conv, n AS todo, {START} FROM counts
  UNION ALL
  SELECT conv, todo, {", ".join(f"{inserted(s)} AS s{s}" for s in range(4))}
  FROM (
    SELECT best.conv, best.todo - 1 AS todo, {", ".join(f"{plain(s)} AS p{s}" for s in range(4))}
    FROM best JOIN marked ON marked.conv = best.conv AND marked.place = best.todo
  )
), solved AS (
  SELECT conv, s0.cost AS cost, s0.audit AS audit, sha256(array_to_string(s0.rows, chr(10))) AS repaired_sha256 FROM best WHERE todo = 0
)
SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM original) ids LEFT JOIN counts USING (conv) LEFT JOIN solved USING (conv)
"""
