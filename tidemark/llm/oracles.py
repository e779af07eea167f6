"""DuckDB SQL for the queries that SQL can express, written out by itself: nothing here comes from the operators."""

from __future__ import annotations

from itertools import permutations


def _found() -> str:
    # DuckDB wants patterns as constants, so each kind is a select of its own.
    kinds = {
        "assign": (0, 6, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
        "access": (1, 20, "AKIA[A-Z0-9]+", 0),
        "hex": (2, 24, "[0-9a-f]+", 0),
        "pem": (3, 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:([^-]*(?:-[^-]+){0,16})-----END [A-Z ]{0,40}PRIVATE KEY-----)?", 1),
        "jwt": (4, 1, "(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,})", 1),
    }
    return "\nUNION ALL ".join(
        f"SELECT row, doc_id, source, '{k}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(t, $${p}$$) AS gaps, regexp_extract_all(t, $${p}$$, 0) AS whole, regexp_extract_all(t, $${p}$$, {g}) AS vals FROM d"
        for k, (rank, least, p, g) in kinds.items()
    )


OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({_found()}),
each_one AS (SELECT row, doc_id, source, kind, rank, least, i, vals[i] AS val, whole[i] AS w, length(gaps[i]) AS gap FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM raw WHERE len(whole) > 0)),
placed AS (
  SELECT row, doc_id, source, kind, rank, least, val, w, CASE WHEN kind = 'jwt' THEN length(val) ELSE length(w) END AS n,
    sum(gap + length(w)) OVER (PARTITION BY row, kind ORDER BY i ROWS UNBOUNDED PRECEDING) - CASE WHEN kind = 'jwt' THEN length(val) ELSE length(w) END AS start
  FROM each_one),
valued AS (
  SELECT *, CASE WHEN kind <> 'pem' THEN val ELSE coalesce(nullif(regexp_replace(val, '[ \t\n\x0B\f\r]|\\[nr]', '', 'g'), ''), w) END AS value
  FROM placed),
found AS (SELECT row, doc_id, source, kind, rank, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, value FROM valued WHERE length(value) >= least),
owned AS (
  SELECT value, count(DISTINCT coalesce(source, chr(1))) AS n_owners, count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(CAST(doc_id AS VARCHAR), '')) AS n_repositories
  FROM found GROUP BY value),
judged AS (
  SELECT f.*, n_owners, n_repositories, CASE WHEN n_owners >= 3 OR n_repositories >= 10 THEN 'copied'
    WHEN n_owners = 1 AND length(f.value) >= 12
      AND CAST(regexp_matches(f.value, '[a-z]') AS INT) + CAST(regexp_matches(f.value, '[A-Z]') AS INT) + CAST(regexp_matches(f.value, '[0-9]') AS INT) >= 2
      AND NOT regexp_matches(f.value, CASE WHEN kind = 'pem' THEN '(?i)example|sample|change_?me|placeholder|dummy|your[_-]' ELSE '(?i)example|sample|change_?me|placeholder|dummy|your[_-]|xxxx|0000|test' END)
      AND len(list_distinct(string_split(f.value, ''))) >= 8 THEN 'live'
    ELSE 'unclear' END AS verdict
  FROM found f JOIN owned o ON f.value = o.value),
summed AS (
  SELECT row, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))}, {", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in ("live", "copied", "unclear"))},
    max(n_repositories) AS most_repositories, max(n_owners) AS most_owners,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM judged GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_live", "n_copied", "n_unclear", "most_repositories", "most_owners"))}
FROM d LEFT JOIN summed USING (row)
"""


def _tree(name: str, leaves: str, depth: int) -> str:
    """Levels of a tree over ``leaves`` (g, i, n, h), ``depth`` of them: each node with what stands before and after it in its run of eight."""
    parts = []
    for k in range(depth):
        below = leaves if k == 0 else f"""(SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1} GROUP BY g, {name}{k - 1}.i // 8)"""
        side = lambda frame: f"CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {frame}), '') END"
        parts.append(f"{name}{k} AS MATERIALIZED (SELECT g, i, n, h, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {below})")
    return ",\n".join(parts)


def _climb(start: str, depth: int, table: str, source: str) -> str:
    """One common table expression a level, since nested CASEs would double at each."""
    parts = []
    for k in range(depth):
        parts.append(f"{source}{k + 1} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN t.n = 1 THEN f ELSE sha256(t.b || f || t.a) END AS f, proof || t.b || t.a AS proof FROM {source}{k} x JOIN {table}{k} t ON x.{start}g = t.g AND x.{start}i // {8**k} = t.i)")
    return ",\n".join(parts)


#: Levels of a group's tree, and of the tree of groups: 8 ** 8 documents a language and 8 ** 4 languages.
TREE, TOP = 9, 5
_CRC = "CAST(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, y: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda z, _: xor(z >> 1, 3988292384 * (z & 1)), xor(x, y)), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT)"


def _leaf(text: str) -> str:
    framed = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13 = f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h, coalesce(tampered, h) AS f
  FROM (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf('text')} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOWER)} END AS tampered FROM documents)),
{_tree('low', '(SELECT g, i, n, h FROM leaves)', TREE)},
tops AS MATERIALIZED (SELECT g AS sub, h AS subroot, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM low{TREE - 1}),
{_tree('high', '(SELECT g, i, n, h FROM tops)', TOP)},
climb0 AS (SELECT l.doc_id, l.h AS leaf, l.g, l.i, t.subroot, t.g AS top_g, t.i AS top_i, l.f, '' AS proof FROM leaves l JOIN tops t ON l.g = t.sub),
{_climb('', TREE, 'low', 'climb')},
rise0 AS (SELECT * FROM climb{TREE}),
{_climb('top_', TOP, 'high', 'rise')}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM rise{TOP} CROSS JOIN high{TOP - 1} r
"""


def _steps() -> str:
    place = {f: 1 << i for i, f in enumerate("ABCDE")}
    return ", ".join(f"('{''.join(p)}', {i + 1}, {place[f]}, {sum(place[x] for x in p[:i])})" for p in permutations("ABCDE") for i, f in enumerate(p))


OP11 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
flagged AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d),
judged AS (SELECT doc_id, CAST(bool_or(quality = 1) AS BIGINT) AS good, CAST(bool_or(toxic = 1) AS BIGINT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flagged f LEFT JOIN judged j ON f.doc_id = j.doc_id GROUP BY part, mask),
steps(filter_order, step, bit, earlier) AS (VALUES {_steps()}),
each AS (SELECT *, (mask & bit) <> 0 AS fails, (mask & earlier) <> 0 AS gone FROM m CROSS JOIN steps)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce(sum({v}) FILTER (WHERE {c}), 0) AS BIGINT) AS {n}" for n, v, c in (("kept", "n", "NOT fails AND NOT gone"), ("removed", "n", "fails AND NOT gone"), ("redundant", "n", "fails AND gone"), ("unique_fails", "n", "mask = bit"), ("good_lost", "good", "fails AND NOT gone"), ("toxic_lost", "toxic", "fails AND NOT gone"), ("shapley", "n * 120 // greatest(bit_count(mask), 1)", "fails")))}
FROM each GROUP BY part, filter_order, step
"""
