"""Plain SQL with the expected result of each registered query.

Written over segments (runs of token and of delimiter characters) and list
positions, a different route from the Spark operators.
"""

from __future__ import annotations

from ..constants import ESCAPED

_TOKEN = r"+\-./0-9A-Z\\_a-z"
_SEGMENTS = f"[{_TOKEN}]+|[^{_TOKEN}]+"

_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
)
_EVENT_MSG = (
    "event_type || ' user=' || user_id || ' owner=' || ['alice', 'bob', 'carol', 'dave'][user_id % 4 + 1] || ' value=' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"
    " || ' session=s' || user_id || '-' || event_id % 40 || ' props=' || props"
)

MESSAGES = {
    "events": f"SELECT event_type AS source, event_id AS seq, (epoch_us(ts) // 1000) AS ts_ms, {_EVENT_MSG} AS msg FROM events",
    "documents": "SELECT 'documents' AS source, doc_id AS seq, doc_id * 1000 AS ts_ms, text AS msg FROM documents",
    "pages": "SELECT 'pages' AS source, page_id AS seq, page_id * 1000 AS ts_ms, html AS msg FROM pages",
    "conversations": (
        "SELECT 'conv-' || conv_id AS source, turn AS seq, turn * 1000 AS ts_ms, text AS msg FROM conversations"
    ),
}

_LINE = f"""strftime(ts, '%y/%m/%d %H:%M:%S') || ' ' || {_LEVEL} || ' app.' || event_type || ': ' || {_EVENT_MSG} ||
  CASE {_LEVEL} WHEN 'ERROR' THEN chr(10) || chr(9) || 'at app.run(worker-' || user_id % 8 || ')' || chr(10) || chr(9) || 'at app.main'
       WHEN 'WARN' THEN '  ' ELSE '' END"""


def _escaped(column: str) -> str:
    out = column
    for raw, code in ESCAPED.items():
        chars = " || ".join(f"chr({ord(c)})" for c in code)
        out = f"replace({out}, chr({ord(raw)}), {chars})"
    return out


def _is_variable(token: str, before: str) -> str:
    return (
        f"(regexp_matches({token}, '[0-9]') OR (coalesce(right({before}, 1) = '=', false)"
        f" AND regexp_matches({token}, '[A-Za-z]')) OR regexp_full_match({token}, '[0-9A-Fa-f]{{2,}}'))"
    )


def int_value(token: str, sql_type: str = "BIGINT") -> str:
    return (
        f"CASE WHEN regexp_full_match({token}, '0|-?[1-9][0-9]*')"
        f" THEN CAST(TRY_CAST({token} AS {sql_type}) AS BIGINT) END"
    )


def decimal_value(token: str, width: int = 64) -> str:
    most, step, low = (16, 16, "(-9223372036854775807 - 1)") if width == 64 else (8, 8, "-2147483648")
    digits = f"replace(replace({token}, '-', ''), '.', '')"
    amount = f"TRY_CAST({digits} AS BIGINT)"
    limit = "" if width == 64 else f" AND {amount} < 33554432"
    return f"""CASE WHEN regexp_full_match({token}, '-?[0-9]*\\.[0-9]+') AND length({digits}) <= {most}{limit}
      THEN {amount} * {step * step} + (length({digits}) - 1) * {step} + (length({token}) - strpos({token}, '.') - 1)
           + CASE WHEN {token} LIKE '-%' THEN {low} ELSE 0 END END"""


def typed(*tables: str, mode: str = "standard", name: str = "") -> str:
    """Common table expressions ending in ``typed``: one row per segment, ``kind`` NULL for constants."""
    rows = " UNION ALL ".join(MESSAGES[t] for t in tables)
    number = int_value("tok", "INTEGER" if mode == "compact" else "BIGINT")
    decimal = {"int_only": "NULL::BIGINT", "standard": decimal_value("tok"), "compact": decimal_value("tok", 32)}[mode]
    n = name
    return f"""message{n} AS ({rows}),
segments{n} AS (SELECT source, seq, ts_ms, regexp_extract_all(msg, '{_SEGMENTS}') AS s FROM message{n}),
pieces{n} AS (SELECT source, seq, ts_ms, unnest(s) AS tok, generate_subscripts(s, 1) AS i FROM segments{n}),
placed{n} AS (SELECT *, lag(tok) OVER (PARTITION BY source, seq ORDER BY i) AS before FROM pieces{n}),
found{n} AS (SELECT *, regexp_full_match(tok, '[{_TOKEN}]+') AND {_is_variable('tok', 'before')} AS is_var FROM placed{n}),
numbered{n} AS (SELECT *, CASE WHEN is_var THEN {number} END AS num, CASE WHEN is_var THEN {decimal} END AS dec FROM found{n}),
typed{n} AS (SELECT source, seq, ts_ms, i, tok, coalesce(num, dec) AS enc,
  CASE WHEN NOT is_var THEN NULL WHEN num IS NOT NULL THEN 17 WHEN dec IS NOT NULL THEN 19 ELSE 18 END AS kind FROM numbered{n}),
vars{n} AS (SELECT source, seq, ts_ms, row_number() OVER (PARTITION BY source, seq ORDER BY i) - 1 AS pos,
  kind, tok, enc FROM typed{n} WHERE kind IS NOT NULL),
logtypes{n} AS (SELECT source, seq, any_value(ts_ms) AS ts_ms,
  string_agg(CASE WHEN kind IS NULL THEN {_escaped('tok')} ELSE chr(kind) END, '' ORDER BY i) AS logtype,
  count(kind) AS n_vars FROM typed{n} GROUP BY source, seq)"""


def dictionaries(name: str = "") -> str:
    """Common table expressions ``logtype_dict`` and ``variable_dict`` on top of :func:`typed`."""
    n = name

    def dictionary(value: str, rows: str) -> str:
        return f"""SELECT row_number() OVER (ORDER BY first, value) - 1 AS id, sha256(value) AS digest, value, n
  FROM (SELECT {value} AS value, min(first) AS first, count(*) AS n FROM ({rows}) GROUP BY 1)"""

    by_event = f"SELECT logtype, seq::HUGEINT * 2147483648 AS first FROM logtypes{n}"
    by_place = f"SELECT tok, seq::HUGEINT * 2147483648 + pos AS first FROM vars{n} WHERE kind = 18"
    return f"""logtype_dict{n} AS ({dictionary('logtype', by_event)}),
variable_dict{n} AS ({dictionary('tok', by_place)})"""


def records(mode: str, op_encoded: int = 64) -> str:
    """Common table expression ``rec``: the deduplicated record stream on top of :func:`typed`."""
    kinds = "" if mode == "shared" else "op, "
    first = f"""CASE WHEN digest IS NOT NULL THEN
  CASE WHEN row_number() OVER (PARTITION BY source, {kinds}digest ORDER BY seq, pos) = 1 THEN 1 ELSE 0 END END"""
    shown = {
        "none": ("NULL::VARCHAR", "literal", "NULL::BIGINT"),
        "marked": ("NULL::VARCHAR", "literal", "first"),
        "shared": ("digest", "CASE WHEN first = 1 THEN literal END", "first"),
        "separate": ("digest", "CASE WHEN first = 1 THEN literal END", "first"),
    }[mode]
    return f"""raw AS (
  SELECT source, seq, pos, CASE WHEN kind = 18 THEN 48 ELSE {op_encoded} END AS op,
         CASE WHEN kind = 18 THEN tok END AS literal, enc AS value FROM vars
  UNION ALL SELECT source, seq, n_vars, 32, logtype, NULL FROM logtypes
  UNION ALL SELECT source, seq, n_vars + 1, 16, NULL, ts_ms FROM logtypes),
keyed AS (SELECT *, sha256(literal) AS digest FROM raw),
seen AS (SELECT *, {first} AS first FROM keyed),
rec AS (SELECT source, seq, CAST(pos AS BIGINT) AS pos, CAST(op AS BIGINT) AS op, {shown[0]} AS digest,
  {shown[1]} AS literal, CAST({shown[2]} AS BIGINT) AS first, value FROM seen)"""


def _record_bytes(mode: str) -> str:
    key = 32 if mode in ("shared", "separate") else 0
    size = "CASE WHEN strlen(literal) <= 127 THEN 1 WHEN strlen(literal) <= 32767 THEN 2 ELSE 4 END + strlen(literal)"
    return f"""WITH {typed('pages')}, {records(mode)}
SELECT source, count(*) AS records, CAST(sum(CASE WHEN op IN (16, 64) THEN 9
  ELSE 1 + {key} + CASE WHEN literal IS NULL THEN 0 ELSE {size} END END) AS BIGINT) AS bytes FROM rec GROUP BY source"""


def _number(kind: str) -> str:
    whole = {
        "int32": "l_orderkey::HUGEINT * l_partkey * l_suppkey",
        "int64": "l_orderkey::HUGEINT * l_partkey * l_suppkey * 98765432",
        "decimal": "CAST(l_extendedprice AS DECIMAL(12,2))",
        "long_decimal": "CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(1000003 AS DECIMAL(7,0))",
    }[kind]
    return f"""n AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN '0' ELSE '' END
  || CAST({whole} AS VARCHAR) AS token FROM lineitem)"""


def _numbers(kind: str, value: str, decoded: bool = False) -> str:
    shown = f"CASE WHEN ({value}) IS NOT NULL THEN token END AS decoded" if decoded else f"{value} AS enc"
    return f"WITH {_number(kind)} SELECT l_orderkey, l_linenumber, token, {shown} FROM n"


def _logtypes(table: str, mode: str = "standard") -> str:
    return f"WITH {typed(table, mode=mode)} SELECT source, seq, logtype FROM logtypes"


def _variables(table: str) -> str:
    return f"WITH {typed(table)} SELECT source, seq, pos, tok AS token FROM vars"


def _encoded(table: str, mode: str = "standard") -> str:
    return f"WITH {typed(table, mode=mode)} SELECT source, seq, pos, CAST(kind AS BIGINT) AS kind, tok AS text, enc FROM vars"


def _dictionary(table: str, which: str, mode: str = "standard", shown: str = "id, digest, value, n") -> str:
    return f"WITH {typed(table, mode=mode)}, {dictionaries()} SELECT {shown} FROM {which}_dict"


def _records(mode: str, encode_mode: str = "standard", op: int = 64) -> str:
    return f"WITH {typed('events', mode=encode_mode)}, {records(mode, op)} SELECT * FROM rec"


_TOKEN_ROWS = f"""pieces AS (SELECT seq, unnest(s) AS token, generate_subscripts(s, 1) AS i FROM
  (SELECT seq, regexp_extract_all(msg, '{_SEGMENTS}') AS s FROM ({{rows}}))),
placed AS (SELECT seq, token, lag(token) OVER (PARTITION BY seq ORDER BY i) AS before FROM pieces),
tokens AS (SELECT * FROM placed WHERE regexp_full_match(token, '[{_TOKEN}]+'))"""


def _token_rows(table: str) -> str:
    return _TOKEN_ROWS.format(rows=MESSAGES[table])


def _plain(table: str) -> str:
    return f"SELECT source, seq, ts_ms, msg FROM ({MESSAGES[table]})"


_PARSED = f"""SELECT ((epoch_us(ts) // 1000) // 1000) * 1000 AS ts_ms, {{msg}} AS msg
FROM (SELECT *, substr(line, 18) AS rest FROM (SELECT ts, event_id, {_LINE} AS line FROM events))"""
_STRIPPED = _PARSED.format(msg=r"regexp_replace(rest, '\s+$', '')")

_FIXED_LINES = f"""SELECT CASE WHEN pos = 1 THEN ((epoch_us(ts) // 1000) // 1000) * 1000 END AS ts_ms, substr(part, 18) AS msg
FROM (SELECT ts, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
      FROM (SELECT ts, string_split({_LINE}, chr(10)) AS parts FROM events))"""

_TEXT_LINES = f"SELECT unnest(string_split({_LINE}, chr(10))) AS line FROM events"

_EVENT_LINES = f"""SELECT event_type AS source, event_id AS seq,
  strftime(ts, '%y/%m/%d %H:%M:%S ') || {_EVENT_MSG} AS line FROM events"""


def _rolled(max_bytes: int) -> str:
    return f"""SELECT source, seq, line, CAST((sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY seq)
  - strlen(line) - 1) // {max_bytes} AS BIGINT) AS file_no FROM ({_EVENT_LINES})"""


_TIME = "strftime(ts, '%H:%M:%S.') || lpad(CAST(((epoch_us(ts) // 1000) % 1000) AS VARCHAR), 3, '0')"
_LAYOUT_REST = (
    f"rpad({_LEVEL}, 5, ' ') || ' [worker-' || user_id % 8 || '] app.' || event_type || ' - ' || {_EVENT_MSG} || chr(10)"
)


def _hex_bytes(value: str, width: int) -> str:
    """Two's complement of an integer as ``width`` bytes of hexadecimal text."""
    whole = f"(({value})::HUGEINT + CASE WHEN ({value}) < 0 THEN {1 << (8 * width)}::HUGEINT ELSE 0 END)"
    return f"lower(right('{'0' * 2 * width}' || to_hex({whole}), {2 * width}))"


def _payload(mode: str, id_bytes: int) -> str:
    width = 4 if mode == "compact" else 8
    return f"""WITH {typed('events', mode=mode)}, {dictionaries()},
encoded_vars AS (SELECT v.source, v.seq, v.pos, coalesce(v.enc, d.id) AS enc
  FROM vars v LEFT JOIN variable_dict d ON v.kind = 18 AND v.tok = d.value),
words AS (SELECT source, seq, string_agg({_hex_bytes('enc', width)}, '' ORDER BY pos) AS words FROM encoded_vars GROUP BY 1, 2)
SELECT l.source, l.seq, {_hex_bytes('l.ts_ms', 8)} || {_hex_bytes('d.id', id_bytes)} || coalesce(w.words, '') AS payload
FROM logtypes l JOIN logtype_dict d ON l.logtype = d.value LEFT JOIN words w ON l.source = w.source AND l.seq = w.seq"""


def _archive(*tables: str, mode: str = "standard") -> str:
    return f"""WITH {typed(*tables, mode=mode)}, {dictionaries()},
encoded_vars AS (SELECT v.source, v.seq, v.pos, coalesce(v.enc, d.id) AS enc
  FROM vars v LEFT JOIN variable_dict d ON v.kind = 18 AND v.tok = d.value),
var_lists AS (SELECT source, seq, string_agg(CAST(enc AS VARCHAR), ',' ORDER BY pos) AS vars FROM encoded_vars GROUP BY 1, 2)
SELECT l.source, l.seq, l.ts_ms, d.id AS logtype_id, coalesce(v.vars, '') AS vars
FROM logtypes l JOIN logtype_dict d ON l.logtype = d.value LEFT JOIN var_lists v ON l.source = v.source AND l.seq = v.seq"""


# Segments of the compact form: 32,768 dictionary variables in the order of source and seq (fixed value).
_SEGMENTED = f"""{typed('events', mode='compact')},
weights AS (SELECT l.source, l.seq, greatest(1, count(v.kind)) AS w
  FROM logtypes l LEFT JOIN vars v ON l.source = v.source AND l.seq = v.seq AND v.kind = 18 GROUP BY 1, 2),
segment_of AS (SELECT source, seq, CAST((sum(w) OVER (ORDER BY source, seq) - 1) // 32768 AS BIGINT) AS segment FROM weights),
own_vars AS (SELECT v.*, segment FROM vars v JOIN segment_of USING (source, seq)),
own_logtypes AS (SELECT l.*, segment FROM logtypes l JOIN segment_of USING (source, seq)),
logtype_dict AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY first, value) - 1 AS id, value, n
  FROM (SELECT segment, logtype AS value, min(seq) AS first, count(*) AS n FROM own_logtypes GROUP BY 1, 2)),
variable_dict AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY first, value) - 1 AS id, value, n
  FROM (SELECT segment, tok AS value, min(seq::HUGEINT * 2147483648 + pos) AS first, count(*) AS n
        FROM own_vars WHERE kind = 18 GROUP BY 1, 2)),
encoded_vars AS (SELECT v.source, v.seq, v.pos, coalesce(v.enc, d.id) AS enc
  FROM own_vars v LEFT JOIN variable_dict d ON v.kind = 18 AND v.tok = d.value AND v.segment = d.segment)"""

_COMPACT_ARCHIVE = f"""WITH {_SEGMENTED},
var_lists AS (SELECT source, seq, string_agg(CAST(enc AS VARCHAR), ',' ORDER BY pos) AS vars FROM encoded_vars GROUP BY 1, 2)
SELECT l.source, l.seq, l.ts_ms, l.segment, d.id AS logtype_id, coalesce(v.vars, '') AS vars
FROM own_logtypes l JOIN logtype_dict d ON l.logtype = d.value AND l.segment = d.segment
LEFT JOIN var_lists v ON l.source = v.source AND l.seq = v.seq"""

_COMPACT_PAYLOAD = f"""WITH {_SEGMENTED},
words AS (SELECT source, seq, string_agg({_hex_bytes('enc', 4)}, '' ORDER BY pos) AS words FROM encoded_vars GROUP BY 1, 2)
SELECT l.source, l.seq, l.segment, {_hex_bytes('l.ts_ms', 8)} || {_hex_bytes('d.id', 2)} || coalesce(w.words, '') AS payload
FROM own_logtypes l JOIN logtype_dict d ON l.logtype = d.value AND l.segment = d.segment
LEFT JOIN words w ON l.source = w.source AND l.seq = w.seq"""


_SIZE_REPORT = f"""WITH {typed('events', mode='int_only')}, {dictionaries()},
parts AS (SELECT
  (SELECT count(*) FROM logtypes) AS events,
  (SELECT count(*) FROM vars) AS variables_total,
  (SELECT CAST(sum(strlen(msg) + 1) AS BIGINT) FROM message) AS original_bytes,
  (SELECT CAST(sum(strlen(value) + 1) AS BIGINT) FROM logtype_dict) AS logtype_dict_bytes,
  (SELECT count(*) FROM logtype_dict) AS logtypes,
  (SELECT CAST(sum(strlen(value) + 1) AS BIGINT) FROM variable_dict) AS variable_dict_bytes,
  (SELECT count(*) FROM variable_dict) AS variables),
sized AS (SELECT *, events * 8 AS ts_bytes, events * 2 AS logtype_bytes_2, events * 4 AS logtype_bytes_4,
  events * 8 AS logtype_bytes_8, variables_total * 8 AS var_bytes FROM parts),
totals AS (SELECT *, logtype_dict_bytes + variable_dict_bytes + ts_bytes + var_bytes + logtype_bytes_2 AS min_bytes,
  logtype_dict_bytes + variable_dict_bytes + ts_bytes + var_bytes + logtype_bytes_8 AS max_bytes FROM sized)
SELECT *, logtype_dict_bytes * 100 // min_bytes AS logtype_dict_pct, variable_dict_bytes * 100 // min_bytes AS variable_dict_pct,
  ts_bytes * 100 // min_bytes AS ts_pct, logtype_bytes_2 * 100 // min_bytes AS logtype_2_pct,
  logtype_bytes_8 * 100 // max_bytes AS logtype_8_pct, var_bytes * 100 // min_bytes AS var_pct,
  round(original_bytes / min_bytes, 4) AS ratio_max, round(original_bytes / max_bytes, 4) AS ratio_min FROM totals"""

_UPSERT = f"""WITH {typed('documents', name='_a')}, {dictionaries('_a')}, {typed('pages', name='_b')},
batch AS (SELECT tok AS value, min(seq::HUGEINT * 2147483648 + pos) AS first, count(*) AS n FROM vars_b WHERE kind = 18 GROUP BY 1),
fresh AS (SELECT * FROM batch WHERE value NOT IN (SELECT value FROM variable_dict_a))
SELECT a.id, a.value, a.n + coalesce(b.n, 0) AS n FROM variable_dict_a a LEFT JOIN batch b ON a.value = b.value
UNION ALL SELECT (SELECT max(id) FROM variable_dict_a) + row_number() OVER (ORDER BY first, value), value, n FROM fresh"""

_MARKERS = f"""WITH {typed('documents')}, {records('marked')}
SELECT CAST(op + CASE WHEN literal IS NULL THEN 0 ELSE CASE WHEN strlen(literal) <= 127 THEN 1 WHEN strlen(literal) <= 32767 THEN 2 ELSE 3 END
  + CASE WHEN first = 1 THEN 3 ELSE 0 END END AS BIGINT) AS marker, count(*) AS n FROM rec GROUP BY 1"""

_SENT_LITERALS = f"""WITH {typed('events')}, {records('separate')}
SELECT source, op, digest, literal FROM rec WHERE literal IS NOT NULL"""

# Three batches by the number of the event; a literal is sent again after six hours without it (fixed values).
_BATCH = "CAST(floor(seq * 3 / ((SELECT max(event_id) FROM events) + 1)) AS BIGINT)"
_RESENT = f"""WITH {typed('events')},
uses AS (SELECT source, seq, 48 AS op, tok AS literal, ts_ms FROM vars WHERE kind = 18
  UNION ALL SELECT source, seq, 32, logtype, ts_ms FROM logtypes),
timed AS (SELECT *, max(ts_ms) OVER (PARTITION BY source, op, literal ORDER BY {_BATCH}, ts_ms
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM uses)
SELECT source, CAST(op AS BIGINT) AS op, sha256(literal) AS digest, literal, ts_ms FROM timed
WHERE before IS NULL OR ts_ms - before > 21600000"""

_OBSERVED = f"""SELECT {_BATCH} AS batch, count(*) AS n_events, CAST(sum(strlen(msg)) AS BIGINT) AS n_bytes, true AS has_rate
FROM ({MESSAGES['events']}) GROUP BY 1"""

_NEWEST_FILES = f"""SELECT source, file_no, line FROM (SELECT *, max(file_no) OVER (PARTITION BY source) AS newest
  FROM ({_rolled(10_000)})) WHERE file_no > newest - 10"""

_ODD_BYTES = f"""SELECT source, seq, CASE WHEN seq % 11 = 0 THEN '75c328' || lower(hex(encode(msg))) || 'ff'
  ELSE lower(hex(encode(msg))) END AS bytes FROM ({MESSAGES['events']})"""

_SYNTHETIC = (
    "'This is a log message with one spark unique app id per line: app-20201119' || event_id % 1000 || '-'"
    " || event_id % 20000 || ' from spark-node-' || event_id % 1000"
)

ORACLE: dict[str, str] = {
    "stitch_events": """SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq,
  sha256('24/01/01 00:00:00 ' || text) AS text_digest FROM documents""",
    "parse_logs": _STRIPPED,
    "parse_logs_whole_files": _STRIPPED,
    "parse_logs_unstripped": _PARSED.format(msg="rest"),
    "parse_lines_fixed": _FIXED_LINES,
    "split_timestamp": _STRIPPED.replace("SELECT", "SELECT event_id AS seq,", 1),
    "synthetic_logs": f"SELECT event_id, {_SYNTHETIC} AS msg FROM events",
    "synthetic_columns": """SELECT event_id AS ts, event_id AS logtype, (event_id * 4) || ',' || (event_id * 4 + 1) || ','
  || (event_id * 4 + 2) || ',' || (event_id * 4 + 3) AS vars FROM events""",
    "plain_text": _TEXT_LINES,
    "gzip_text": _TEXT_LINES,
    "zstd_text": _TEXT_LINES,
    "zstd_column": _TEXT_LINES,
    "rolling_files": f"SELECT source, seq, file_no FROM ({_rolled(20_000)})",
    "rolling_text": _NEWEST_FILES,
    "running_bytes": """SELECT doc_id AS seq, CAST(sum(strlen(text)) OVER (ORDER BY doc_id) AS BIGINT) AS total_bytes
  FROM documents""",
    "tokenize_documents": f"""SELECT seq, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_digest
  FROM (SELECT seq, regexp_extract_all(msg, '[{_TOKEN}]+') AS t FROM ({MESSAGES['documents']}))""",
    "variables_documents": _variables("documents"),
    "variables_pages": _variables("pages"),
    "variables_conversations": _variables("conversations"),
    "hex_tokens": f"""WITH {_token_rows('documents')} SELECT token, count(*) AS n FROM tokens
  WHERE regexp_full_match(token, '[0-9A-Fa-f]{{2,}}') GROUP BY token""",
    "eq_tokens": f"""WITH {_token_rows('events')} SELECT token, count(*) AS n FROM tokens
  WHERE right(before, 1) = '=' AND regexp_matches(token, '[A-Za-z]') AND NOT regexp_matches(token, '[0-9]')
    AND NOT regexp_full_match(token, '[0-9A-Fa-f]{{2,}}') GROUP BY token""",
    "variable_tokens": f"""WITH {_token_rows('pages')} SELECT seq, count(*) AS n_variables FROM tokens
  WHERE {_is_variable('token', 'before')} GROUP BY seq""",
    "classify_standard": f"WITH {typed('pages')} SELECT seq, tok AS token, CAST(kind AS BIGINT) AS kind FROM vars",
    "classify_compact": f"""WITH {typed('pages', mode='compact')}
  SELECT seq, tok AS token, CAST(kind AS BIGINT) AS kind FROM vars""",
    "logtype_documents": _logtypes("documents"),
    "logtype_events": _logtypes("events"),
    "logtype_int_only": _logtypes("events", "int_only"),
    "logtype_compact": _logtypes("events", "compact"),
    "logtype_pages": _logtypes("pages"),
    "encode_events": _encoded("events"),
    "encode_documents": _encoded("documents"),
    "encode_compact": _encoded("events", "compact"),
    "encode_int_only": _encoded("events", "int_only"),
    "template_counts": f"""WITH {typed('documents')},
kinds AS (SELECT seq, count(*) FILTER (kind = 17) AS a, count(*) FILTER (kind = 18) AS b, count(*) FILTER (kind = 19) AS c
  FROM typed GROUP BY seq)
SELECT logtype, count(*) AS n_events, CAST(sum(a) AS BIGINT) AS n_int, CAST(sum(b) AS BIGINT) AS n_dict,
  CAST(sum(c) AS BIGINT) AS n_decimal FROM logtypes JOIN kinds USING (seq) GROUP BY logtype""",
    "encode_ints": _numbers("int64", int_value("token")),
    "encode_ints32": _numbers("int32", int_value("token", "INTEGER")),
    "encode_decimals64": _numbers("decimal", decimal_value("token")),
    "encode_decimals32": _numbers("decimal", decimal_value("token", 32)),
    "encode_long_decimals": _numbers("long_decimal", decimal_value("token")),
    "decode_ints": _numbers("int64", int_value("token"), decoded=True),
    "decode_decimals64": _numbers("long_decimal", decimal_value("token"), decoded=True),
    "decode_decimals32": _numbers("decimal", decimal_value("token", 32), decoded=True),
    "level_filter": f"""SELECT event_id AS seq, {_LEVEL} AS level, {_EVENT_MSG} AS msg FROM events
  WHERE {_LEVEL} IN ('WARN', 'ERROR') AND event_id % 5 <> 0""",
    "render_layout_events": f"SELECT event_id AS seq, {_TIME} || ' ' || {_LAYOUT_REST} AS line FROM events",
    "strip_layout_timestamp": f"SELECT event_id AS seq, {_TIME} AS time, ' ' || {_LAYOUT_REST} AS line FROM events",
    "error_policy": """SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'bad timestamp'
  WHEN event_id % 11 = 0 THEN 'invalid UTF-8' ELSE 'good' END AS outcome FROM events""",
    "logtype_dictionary": _dictionary("events", "logtype"),
    "logtype_dictionary_documents": _dictionary("documents", "logtype"),
    "variable_dictionary": _dictionary("documents", "variable"),
    "variable_dictionary_pages": _dictionary("pages", "variable"),
    "digest_dictionary": f"SELECT source, seq, sha256(msg) AS digest FROM ({MESSAGES['conversations']})",
    "dense_logtype_ids": _dictionary("events", "logtype", "int_only", "id + 1 AS id, value"),
    "lookup_ids": f"""WITH {typed('events')}, {dictionaries()}
SELECT source, seq, pos, id FROM vars JOIN variable_dict ON tok = value WHERE kind = 18""",
    "upsert_dictionary": _UPSERT,
    "dictionary_bytes": _dictionary(
        "events", "variable", shown="count(*) AS entries, CAST(sum(strlen(value) + 2) AS BIGINT) AS bytes"
    ),
    "dictionary_export": _dictionary(
        "events", "logtype", shown="id, lower(lpad(to_hex(strlen(value)), 4, '0') || hex(value)) AS entry"
    ),
    "compact_dictionary": f"WITH {_SEGMENTED} SELECT segment, id, value, n FROM variable_dict",
    "archive_columns": _archive("events"),
    "archive_columns_documents": _archive("documents"),
    "archive_columns_compact": _COMPACT_ARCHIVE,
    "decode_roundtrip_documents": _plain("documents"),
    "decode_roundtrip_pages": _plain("pages"),
    "decode_roundtrip_events": _plain("events"),
    "decode_roundtrip_conversations": _plain("conversations"),
    **{name: f"SELECT *, true AS named FROM ({_plain('documents')})" for name in ("archive_codec_gzip", "archive_level_19", "archive_uncompressed")},
    "inline_roundtrip": _plain("documents"),
    "inline_roundtrip_compact": _plain("events"),
    "decode_encoded": "SELECT 'documents' AS source, doc_id AS seq, text AS msg FROM documents",
    "decode_lines": f"""SELECT event_id AS seq, strftime(ts, '%Y-%m-%d ') || {_TIME} || ' ' || {_EVENT_MSG} AS line
  FROM events""",
    "row_major_payload": _payload("standard", 8),
    "row_major_compact": _COMPACT_PAYLOAD,
    "row_major_roundtrip": _archive("events"),
    "row_major_text_roundtrip": _plain("pages"),
    "roundtrip_invalid_utf8": _ODD_BYTES,
    "roundtrip_invalid_utf8_inline": _ODD_BYTES,
    "roundtrip_leading_lines": f"""SELECT unnest(string_split(chr(9) || 'tail of ' || event_id || chr(10) || substr(line, 18), chr(10))) AS line
  FROM (SELECT event_id, {_LINE} AS line FROM events)""",
    "records_none": _records("none"),
    "records_shared": _records("shared"),
    "records_separate": _records("separate"),
    "records_marked": _records("marked"),
    "records_compact": _records("separate", "compact", 80),
    "record_bytes_none": _record_bytes("none"),
    "record_bytes_shared": _record_bytes("shared"),
    "record_bytes_separate": _record_bytes("separate"),
    "record_bytes_marked": _record_bytes("marked"),
    "record_markers": _MARKERS,
    "records_to_archive": _archive("events"),
    "records_to_archive_shared": _archive("events"),
    "records_to_archive_none": _archive("events"),
    "records_to_archive_marked": _archive("events"),
    "records_multi_source": _archive("documents", "conversations"),
    "ir_size_report": _SIZE_REPORT,
    "ir_compressed_report": f"""WITH {typed('events')}, {dictionaries()},
n AS (SELECT (SELECT count(*) FROM logtype_dict) AS l, (SELECT count(*) FROM variable_dict) AS v, (SELECT count(*) FROM logtypes) AS e)
SELECT unnest(['logtype_dictionary', 'variable_dictionary', 'timestamps', 'logtype_ids', 'variables', 'whole']) AS part,
  unnest([l, v, e, e, e, e]) AS n_rows, true AS has_bytes FROM n""",
    "compare_formats": """SELECT unnest(['plain', 'gzip', 'zstd', 'columnar', 'row_major', 'inline', 'records_none',
  'records_shared', 'records_separate', 'records_marked']) AS format, n AS n_events, true AS has_bytes
  FROM (SELECT count(*) AS n FROM events)""",
    "logtype_stats": f"""WITH {typed('events')} SELECT logtype, count(*) AS events, max(n_vars) AS variables,
  min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM logtypes GROUP BY logtype""",
    "stream_encode": f"WITH {typed('events')} SELECT source, seq, logtype, n_vars FROM logtypes",
    "stream_logs": _STRIPPED,
    "stream_stitch": _STRIPPED,
    "stream_dictionary": _dictionary("events", "variable", shown="id, value, n"),
    "stream_literals": _SENT_LITERALS,
    "stream_new_literals": _SENT_LITERALS,
    "stream_literals_expiry": _SENT_LITERALS,
    "stream_archive_roundtrip": _plain("events"),
    "stream_records_to_archive": _plain("events"),
    **{f"stream_records_{name}": _plain("events") for name in ("none", "shared", "separate", "marked", "cut")},
    "stream_observed": _OBSERVED,
    "stream_rolling_text": _NEWEST_FILES,
    "stream_literals_resent": _RESENT,
    "append_archive": f"{_plain('documents')} UNION ALL {_plain('conversations')}",
}
