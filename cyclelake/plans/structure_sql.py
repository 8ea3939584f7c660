"""The structural profile of text files as common table expressions, for the SQL side of the profile queries."""

from __future__ import annotations

from cyclelake.sources import profiling as p

BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 13, 10, 12, 11))


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def filled(line: str) -> str:
    """Cells of a line that are not blank."""
    return f"list_filter(list_transform(string_split({line}, d), lambda c: {strip('c')}), lambda c: c <> '')"


def folded(x: str) -> str:
    """Structural form of labels in the scripts of the test texts."""
    return f"regexp_replace(replace(strip_accents(lower(nfc_normalize({x}))), 'ß', 'ss'), '[\\s_.\\-/\\\\]+', '', 'g')"


MARKS = {"semi": ";", "comma": ",", "tab": "\t", "space": " "}
_COUNT = {n: f"length(x) - length(replace(x, '{m}', ''))" for n, m in MARKS.items()}
_REPEATED = ", ".join(f"coalesce(len(list_filter(lines[1:20], lambda x: {c} >= 2)), 0) AS r_{n}" for n, c in _COUNT.items())
_TOTAL = ", ".join(f"coalesce(list_sum(list_transform(lines[1:20], lambda x: {c})), 0) AS t_{n}" for n, c in _COUNT.items())


def _best(kind: str) -> str:
    return "CASE greatest({}) {} END".format(", ".join(f"{kind}_{n}" for n in MARKS), " ".join(f"WHEN {kind}_{n} THEN '{m}'" for n, m in MARKS.items()))


def _score(brand: str) -> str:
    return " + ".join(f"CAST(contains(content, '{s}') AS INTEGER)" for s in p.BRAND_SIGNATURES[brand])


_FIRST = lambda line: f"lower({strip(f'string_split({line}, d)[1]')})"
_HEADER = f"len({filled('x')}) >= 3 AND len(list_filter({filled('x')}, lambda c: regexp_matches(c, '^[a-zA-Z]'))) > greatest(2, len({filled('x')}) * 0.4)"

STRUCTURE_SQL = f"""texts AS (
  SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS length,
         regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS lines FROM documents),
marked AS (SELECT *, {_REPEATED}, {_TOTAL} FROM texts),
cut AS (
  SELECT path, length, lines, CASE WHEN greatest(r_semi, r_comma, r_tab, r_space) > 0 THEN {_best('r')} ELSE {_best('t')} END AS d,
         list_filter(lines, lambda x: {strip('x')} <> '') AS full_lines, list_filter(lines[1:20], lambda x: {strip('x')} <> '') AS head_lines,
         lower(array_to_string(lines[1:30], chr(10))) AS content FROM marked),
turned AS (
  SELECT *,
         (len(full_lines) >= 3 AND {_FIRST('full_lines[1]')} IN {tuple(p.TRANSPOSED_HEADS)}
          AND list_has_any(list_transform(full_lines[2:], lambda x: {_FIRST('x')}), {quoted(p.TRANSPOSED_TIMES)}))
         OR (coalesce(list_sum(list_transform(head_lines, lambda x: len(string_split(x, d)))), 0) / greatest(1, len(head_lines)) > greatest(30, len(full_lines) * 2)) AS is_transposed,
         {", ".join(f"{_score(b)} AS n_{b}" for b in p.BRAND_SIGNATURES)}
  FROM cut),
headed AS (
  SELECT *, CASE WHEN is_transposed THEN 0 ELSE coalesce(list_position(list_transform(lines, lambda x: {_HEADER}), true) - 1, 0) END AS header_row FROM turned),
united AS (
  SELECT *, CASE WHEN NOT is_transposed AND len(list_filter({filled('lines[header_row + 2]')}, lambda c: lower(c) IN {tuple(p.HEADER_UNITS)})) > 1 THEN header_row + 1 END AS unit_row FROM headed),
structured AS (
  SELECT *, CASE WHEN is_transposed THEN 1 ELSE coalesce(unit_row, header_row) + 1 END AS data_start,
         CASE WHEN is_transposed THEN list_transform(lines, lambda x: {strip('string_split(x, d)[1]')}) ELSE {filled('lines[header_row + 1]')} END AS headers,
         CASE WHEN is_transposed THEN [] ELSE lines[1:header_row] END AS metadata,
         CASE WHEN unit_row IS NOT NULL THEN list_transform(string_split(lines[unit_row + 1], d), lambda c: {strip('c')}) END AS units
  FROM united),
keyed AS (
  SELECT *, list_sort(list_distinct(list_filter(list_transform(list_filter(list_transform(metadata, lambda x: {filled('x')}), lambda c: len(c) > 0),
           lambda c: {folded(strip("string_split(c[1], ':')[1]"))}), lambda k: k <> '' AND NOT regexp_matches(k, '^[0-9]+$')))) AS metadata_keys,
         list_filter(list_transform(metadata, lambda x: {filled('x')}), lambda c: len(c) > 1 AND {folded(strip("string_split(c[1], ':')[1]"))} LIKE 'date%') AS dated
  FROM structured)"""
