"""Expected results of the registered queries as DuckDB SQL.

The SQL never parses a log line: it computes each expected field straight
from the ``events`` columns the line was rendered from (see
``logtab.plans.fixtures``), so it is an independent check of the grammars.
Only ``line_order`` and ``natural_order`` render the line text itself, since
there the line is the result.
"""

from __future__ import annotations

E = r"""e AS (
  SELECT event_id AS eid, ts, user_id, event_type, value,
         regexp_extract(props, '(\d+)', 1) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents,
         event_id % 10 AS shape,
         '2020' || strftime(ts, '%m%d%H%M%S') AS a_ts,
         '2020-' || strftime(ts, '%m-%d %H:%M:%S') AS b_dt
  FROM events)"""

RENDERED = E + r""",
p AS (SELECT *, strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' '
                || strftime(ts, '%H:%M:%S') AS pfx FROM e),
r AS (SELECT eid, CASE
  WHEN shape < 5 THEN concat(pfx, ' 10.0.', user_id, '.1 ', strftime(ts, '%Y-%m-%d %H:%M:%S'),
       ' FW-A %%01SEC/4/', upper(event_type), '(l)[', eid, ']:vsys=public, user=', user_id,
       ', value="', cents, '", evt=', event_type, '.')
  WHEN shape < 7 THEN concat(pfx, ' FW-B %%01POLICY/6/', upper(event_type), ':Policy:p', k,
       '; Src User:', user_id, '; Kind:"', event_type, '";')
  WHEN shape < 9 THEN concat(pfx, ' 10.1.', user_id, '.1 +01:00 192.168.0.', eid % 256,
       ' Action="', event_type, '" UserId:="', user_id, '" Note="k ', k, '"',
       CASE WHEN eid % 20 = 7 THEN ' Action="final"' ELSE '' END)
  ELSE concat('   junk ', eid, ' ', event_type, chr(9)) END AS value
  FROM p)"""

# Base fields of the two grammars.
HW_BASE = ["_a_timestamp", "_b_datetime", "_c_interface_1", "_d_interface_2", "_e_event_name",
           "_f_event_brace_round", "_g_event_brace_square"]
CP_BASE = ["_a_timestamp", "_b_datetime", "_c_interface_1", "_d_interface_2"]

HW_WIDE_COLS = """
  a_ts AS "_a_timestamp", b_dt AS "_b_datetime",
  CASE WHEN shape < 5 THEN concat('10.0.', user_id, '.1') END AS "_c_interface_1",
  CASE WHEN shape < 5 THEN 'FW-A' ELSE 'FW-B' END AS "_d_interface_2",
  CASE WHEN shape < 5 THEN '01SEC/4/' ELSE '01POLICY/6/' END || upper(event_type) AS "_e_event_name",
  CASE WHEN shape < 5 THEN 'l' END AS "_f_event_brace_round",
  CASE WHEN shape < 5 THEN CAST(eid AS VARCHAR) END AS "_g_event_brace_square",
  CASE WHEN shape < 5 THEN event_type END AS "evt",
  CASE WHEN shape IN (5, 6) THEN event_type END AS "Kind",
  CASE WHEN shape IN (5, 6) THEN 'p' || k END AS "Policy",
  CASE WHEN shape IN (5, 6) THEN CAST(user_id AS VARCHAR) END AS "Src User",
  CASE WHEN shape < 5 THEN CAST(user_id AS VARCHAR) END AS "user",
  CASE WHEN shape < 5 THEN CAST(cents AS VARCHAR) END AS "value",
  CASE WHEN shape < 5 THEN 'public' END AS "vsys"
"""

CP_WIDE_COLS = """
  a_ts AS "_a_timestamp", b_dt AS "_b_datetime",
  concat('10.1.', user_id, '.1') AS "_c_interface_1",
  concat('192.168.0.', eid % 256) AS "_d_interface_2",
  CASE WHEN eid % 20 = 7 THEN 'final' ELSE event_type END AS "Action",
  'k ' || k AS "Note",
  CAST(user_id AS VARCHAR) AS "UserId"
"""

REJECTS_IN_ORDER = """
SELECT row_number() OVER (ORDER BY eid) AS pos, concat('junk ', eid, ' ', event_type) AS value FROM e WHERE shape = 9"""

ROUTE = "CASE WHEN shape < 7 THEN 'hw' WHEN shape < 9 THEN 'cp' ELSE 'na' END"


def _values(parser: str, keys: list[str]) -> str:
    return ", ".join(f"('{parser}', '{k}')" for k in keys)


def _long(parser: str, where: str, pairs: list[tuple[str, str]]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{parser}' AS parser, eid, '{k}' AS key, {v} AS val FROM e WHERE {where}" for k, v in pairs)


SQL: dict[str, str] = {
    "route_counts": f"WITH {E} SELECT {ROUTE} AS parser, count(*) AS n FROM e GROUP BY 1",

    "cp_header": f"""WITH {E}
SELECT eid, a_ts AS a_timestamp, b_dt AS b_datetime, concat('10.1.', user_id, '.1') AS if1,
       concat('192.168.0.', eid % 256) AS if2
FROM e WHERE shape IN (7, 8)""",

    "hw_header": f"""WITH {E}
SELECT eid, CAST(a_ts AS BIGINT) AS a_timestamp, b_dt AS b_datetime,
  CASE WHEN shape < 5 THEN concat('10.0.', user_id, '.1') END AS if1,
  CASE WHEN shape < 5 THEN 'FW-A' ELSE 'FW-B' END AS if2,
  CASE WHEN shape < 5 THEN '01SEC/4/' ELSE '01POLICY/6/' END || upper(event_type) AS name,
  CASE WHEN shape < 5 THEN 'l' END AS "round",
  CASE WHEN shape < 5 THEN CAST(eid AS VARCHAR) END AS square
FROM e WHERE shape < 7""",

    "hw_params_eq": f"""WITH {E}
SELECT eid, 'public' AS vsys, CAST(user_id AS VARCHAR) AS "user", CAST(cents AS VARCHAR) AS "value",
       event_type AS evt
FROM e WHERE shape < 5""",

    "hw_params_colon": f"""WITH {E}
SELECT eid, 'p' || k AS policy, CAST(user_id AS VARCHAR) AS src_user, event_type AS kind
FROM e WHERE shape IN (5, 6)""",

    "cp_params_lastwins": f"""WITH {E}
SELECT eid, CASE WHEN eid % 20 = 7 THEN 'final' ELSE event_type END AS action,
       CAST(user_id AS VARCHAR) AS userid, 'k ' || k AS note
FROM e WHERE shape IN (7, 8)""",

    "params_long": f"""WITH {E}
{_long("hw", "shape < 5", [("vsys", "'public'"), ("user", "CAST(user_id AS VARCHAR)"),
                           ("value", "CAST(cents AS VARCHAR)"), ("evt", "event_type")])}
  UNION ALL {_long("hw", "shape IN (5, 6)", [("Policy", "'p' || k"), ("Src User", "CAST(user_id AS VARCHAR)"),
                                             ("Kind", "event_type")])}
  UNION ALL {_long("cp", "shape IN (7, 8)", [
        ("Action", "CASE WHEN eid % 20 = 7 THEN 'final' ELSE event_type END"),
        ("UserId", "CAST(user_id AS VARCHAR)"), ("Note", "'k ' || k")])}""",

    "header_keys": f"""WITH {E},
keys AS (
  SELECT * FROM (VALUES {_values("hw", HW_BASE)}, {_values("cp", CP_BASE)}) AS b(parser, key)
  UNION ALL SELECT 'hw', x FROM (VALUES ('vsys'), ('user'), ('value'), ('evt')) v(x)
            WHERE EXISTS (SELECT 1 FROM e WHERE shape < 5)
  UNION ALL SELECT 'hw', x FROM (VALUES ('Policy'), ('Src User'), ('Kind')) v(x)
            WHERE EXISTS (SELECT 1 FROM e WHERE shape IN (5, 6))
  UNION ALL SELECT 'cp', x FROM (VALUES ('Action'), ('UserId'), ('Note')) v(x)
            WHERE EXISTS (SELECT 1 FROM e WHERE shape IN (7, 8)))
SELECT parser, CAST(row_number() OVER (PARTITION BY parser ORDER BY
         CASE WHEN starts_with(key, '_') THEN 0 ELSE 1 END, lower(key), key) AS INTEGER) AS position, key
FROM keys""",

    "hw_wide": f"WITH {E} SELECT eid, {HW_WIDE_COLS} FROM e WHERE shape < 7",

    "cp_wide": f"WITH {E} SELECT eid, {CP_WIDE_COLS} FROM e WHERE shape IN (7, 8)",

    "rejects": f"WITH {E} SELECT eid, concat('junk ', eid, ' ', event_type) AS value FROM e WHERE shape = 9",

    "bad_date_null": f"""WITH {E}
SELECT eid, CASE WHEN eid % 50 = 7 THEN NULL ELSE b_dt END AS b_datetime FROM e WHERE shape IN (7, 8)""",

    "bad_date_reject": f"""WITH {E}
SELECT CASE WHEN shape < 7 THEN 'hw' WHEN shape < 9 AND eid % 50 <> 7 THEN 'cp' ELSE 'na' END AS parser,
       count(*) AS n
FROM e GROUP BY 1""",

    "year_override": f"""WITH {E}
SELECT eid, '2024-' || strftime(ts, '%m-%d %H:%M:%S') AS b_datetime FROM e WHERE shape < 7""",

    "tsv_roundtrip": f"""WITH {E}
SELECT CAST(eid AS VARCHAR) AS eid, {CP_WIDE_COLS} FROM e WHERE shape IN (7, 8)""",

    "line_order": f"WITH {RENDERED} SELECT row_number() OVER (ORDER BY eid) AS pos, value FROM r",

    "natural_order": f"WITH {RENDERED} SELECT row_number() OVER (ORDER BY eid % 997, eid) AS pos, value FROM r",

    "python_parser": f"""WITH {E}
SELECT CASE WHEN shape < 7 THEN 'hw' WHEN shape < 9 THEN 'cp' ELSE 'junk' END AS parser, count(*) AS n
FROM e GROUP BY 1""",

    "python_parser_records": f"""WITH {E}
SELECT eid, CAST(eid AS VARCHAR) AS id, event_type AS type FROM e WHERE shape = 9""",

    "union_sources": f"WITH {E} SELECT eid, {HW_WIDE_COLS} FROM e WHERE shape < 7",

    "multi_parser_precedence": f"""WITH {E}
SELECT CASE WHEN shape < 5 THEN 'hw' WHEN shape < 7 THEN 'fwb' WHEN shape < 9 THEN 'cp' ELSE 'na' END AS parser,
       count(*) AS n
FROM e GROUP BY 1""",

    "mixed_route_counts": f"""WITH {E}
SELECT parser, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT {ROUTE} AS parser, count(*) AS n FROM e GROUP BY 1
  UNION ALL
  SELECT 'na', sum(len(regexp_split_to_array(text, '\\r\\n|\\r|\\n'))) FROM documents
) GROUP BY parser""",

    "stream_route_counts": f"WITH {E} SELECT {ROUTE} AS parser, count(*) AS n FROM e GROUP BY 1",

    "stream_cp_table": f"""WITH {E}
SELECT {CP_WIDE_COLS} FROM e WHERE shape IN (7, 8)""",

    "job_hw_table": f"WITH {E} SELECT {HW_WIDE_COLS} FROM e WHERE shape < 7",

    "job_rejects": f"WITH {E} SELECT concat('junk ', eid, ' ', event_type) AS value FROM e WHERE shape = 9",

    "job_rejects_in_order": f"WITH {E} {REJECTS_IN_ORDER}",

    "stream_ordered_rejects": f"WITH {E} {REJECTS_IN_ORDER}",

    "kept_records": f"WITH {E} SELECT CAST(user_id AS VARCHAR) AS userid, 'k ' || k AS note FROM e WHERE shape IN (7, 8)",

    "parquet_tables": f"WITH {E} SELECT {CP_WIDE_COLS} FROM e WHERE shape IN (7, 8)",

    "cli_table": f"WITH {E} SELECT {CP_WIDE_COLS} FROM e WHERE shape IN (7, 8)",

    "pair_kinds_merge": f"""WITH {E}
SELECT eid, CAST(user_id AS VARCHAR) AS "user", CAST(eid AS VARCHAR) AS mix, '1' AS "end" FROM e""",

    "param_overrides_base": f"""WITH {E}
SELECT eid, 'over' || eid AS "_d_interface_2", '01SEC/4/X' AS "_e_event_name", CAST(eid AS VARCHAR) AS mix FROM e""",

    "empty_keys": f"""WITH {E}
SELECT eid, a_ts AS "1__a_timestamp", b_dt AS "2__b_datetime", '10.1.0.1' AS "3__c_interface_1",
       '192.168.0.1' AS "4__d_interface_2", event_type AS "5_Src", CAST(eid AS VARCHAR) AS "6_src",
       CAST(eid AS VARCHAR) AS nameless
FROM e""",

    "wide_many_columns": f"""WITH {E}
SELECT eid, CAST(5 + 2 * (SELECT count(DISTINCT eid % 5250) FROM e) AS INTEGER) AS n_columns,
       CASE WHEN eid % 5250 = 0 THEN CAST(eid AS VARCHAR) END AS "first",
       CASE WHEN eid % 5250 = 999 THEN CAST(eid AS VARCHAR) END AS other
FROM e""",

    "wide_hostile_keys": f"""WITH {E}
SELECT eid, CAST(eid AS VARCHAR) AS a, 'c' || eid AS "_corrupt_record",
       'v' || eid AS long_key
FROM e""",

    "python_parser_raw_keys": f"""WITH {E}
SELECT eid, ' id' AS key, CAST(eid AS VARCHAR) AS val FROM e WHERE shape = 9
UNION ALL SELECT eid, 'id', event_type FROM e WHERE shape = 9
UNION ALL SELECT eid, ' both ', NULL FROM e WHERE shape = 9""",

    "tsv_linebreaks": """
SELECT CAST(event_id AS VARCHAR) AS eid, event_type || chr(10) || '"x"' || chr(9) || event_type AS lf,
       event_type || chr(13) || chr(10) || 'y' || chr(13) AS cr
FROM events""",

    "tsv_infer_na": """
SELECT event_id AS eid, CASE WHEN event_id % 3 <> 0 THEN event_id END AS whole,
       CASE WHEN event_id % 5 <> 0 THEN event_id / 2.0 END::DOUBLE AS half,
       CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind
FROM events""",

    "tsv_case_twins": 'SELECT CAST(event_id AS VARCHAR) AS "c0_Src", event_type AS "c1_src" FROM events',

    "stream_new_keys": f"""WITH {E}
SELECT a_ts AS "_a_timestamp", b_dt AS "_b_datetime", concat('10.1.', user_id, '.1') AS "_c_interface_1",
       concat('192.168.0.', eid % 256) AS "_d_interface_2",
       CASE WHEN eid % 20 = 7 THEN 'final' ELSE event_type END AS "Action", CAST(user_id AS VARCHAR) AS "UserId",
       '{{"Note":"k ' || k || '"}}' AS "_extra"
FROM e WHERE shape IN (7, 8)""",
}
CP_FIELDS = """concat('"', a_ts, '"', chr(9), '"', b_dt, '"', chr(9), '"10.1.', user_id, '.1"', chr(9), '"192.168.0.', eid % 256, '"',"""

SQL["single_file_rejects"] = SQL["job_rejects_in_order"]

SQL["single_file_table"] = f"""WITH {E}
SELECT 1 AS pos, concat_ws(chr(9), {", ".join(f"""'"{c}"'""" for c in [*CP_BASE, "Action", "Note", "UserId"])}) AS value
UNION ALL
SELECT 1 + row_number() OVER (ORDER BY eid), {CP_FIELDS}
       chr(9), '"', CASE WHEN eid % 20 = 7 THEN 'final' ELSE event_type END, '"', chr(9), '"k ', k, '"', chr(9), '"', user_id, '"')
FROM e WHERE shape IN (7, 8)"""

SQL["wide_many_columns_tsv"] = f"""WITH {E},
used AS (SELECT DISTINCT eid % 5250 AS slot FROM e),
names AS (
  SELECT name, 4 + row_number() OVER (ORDER BY lower(name), name) AS place
  FROM (SELECT 'alt' || slot AS name FROM used UNION ALL SELECT 'key' || slot FROM used)),
sizes AS (SELECT 4 + 2 * count(*) AS width FROM used)
SELECT eid, md5(concat('"', a_ts, '"', chr(9), '"', b_dt, '"', chr(9), '"10.1.0.1"', chr(9), '"192.168.0.1"',
       repeat(chr(9) || '""', CAST(a.place AS INTEGER) - 5), chr(9), '"', eid, '"',
       repeat(chr(9) || '""', CAST(b.place - a.place AS INTEGER) - 1), chr(9), '"', eid, '"',
       repeat(chr(9) || '""', CAST(width - b.place AS INTEGER)))) AS line_md5
FROM e JOIN names a ON a.name = 'alt' || (eid % 5250) JOIN names b ON b.name = 'key' || (eid % 5250) CROSS JOIN sizes"""

SQL["rerun_after_failure"] = f"""WITH r AS ({SQL["bad_date_reject"]}) SELECT *, true AS failed, 0 AS left_behind FROM r"""

SQL["refusals"] = """
SELECT what, error, (SELECT count(*) FROM events) AS n_lines
FROM (VALUES ('missing source', 'AnalysisException'), ('existing output', 'FileExistsError'), ('duplicate names', 'ValueError')) v(what, error)"""

SQL["tsv_linebreaks_split"] = SQL["tsv_linebreaks"]

SQL["many_grammars"] = """
SELECT CASE WHEN event_id % 120 < 100 THEN 'g' || (event_id % 120) ELSE 'na' END AS parser, count(*) AS n,
       CAST(sum(CASE WHEN event_id % 120 < 100 THEN 1 ELSE 0 END) AS BIGINT) AS tried
FROM events GROUP BY 1"""

SQL["latin1_lines"] = "SELECT event_type || ' é ß ÿ ' || event_id AS value FROM events"

SQL["bad_bytes_rejected"] = f"""WITH {E}
SELECT CASE WHEN eid % 7 = 0 THEN 'na' ELSE {ROUTE} END AS parser, eid % 7 = 0 AS bad, count(*) AS n FROM e GROUP BY 1, 2"""

SQL["parse_expression"] = f"""WITH {E}
SELECT eid, {ROUTE} AS parser, CASE WHEN shape < 9 THEN b_dt END AS b_datetime,
       CASE WHEN shape < 9 THEN CAST(user_id AS VARCHAR) END AS "user",
       CASE WHEN shape = 9 THEN concat('junk ', eid, ' ', event_type) END AS reject
FROM e"""

SQL["kept_keys"] = SQL["header_keys"]
