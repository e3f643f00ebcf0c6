"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's
tables with the same data mapping (see ``inputs`` and ``derived``); JSON is
parsed with DuckDB's own JSON functions and next-fit packing is a
recursive CTE walking each file row by row.
"""

from __future__ import annotations

import re

from inkmeter.functions import prompts, responses as R
from inkmeter.functions.tokens import TOKEN_PATTERN
from inkmeter.plans import derived
from inkmeter.plans.catalog import FAILED_FILE as JOB_FAILED_FILE, WAVE_FILES as JOB_WAVE_FILES, ID_BLOCK, PARAMS, PRICE_LIST
from inkmeter.plans.inputs import EXAMPLES_PER_FILE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAT = lit(TOKEN_PATTERN)
STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
FALSY = "('null', '{}', '[]', '\"\"', '0', '0.0', 'false')"


def tok(expr: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({expr}, {PAT})), 0) AS BIGINT)"


def fmt(template: str, *exprs: str) -> str:
    """A %d/%s template as SQL string concatenation."""
    pieces = re.split(r"%[ds]", template)
    out = [lit(pieces[0])]
    for e, p in zip(exprs, pieces[1:]):
        out += [f"CAST({e} AS VARCHAR)", lit(p)]
    return "(" + " || ".join(out) + ")"


USER = lit(prompts.USER_PREFIX)
TOK_SCORE = tok("coalesce(llm_score, '')")
PRICES = ", ".join(f"({lit(m)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in PRICE_LIST)
FAILED_FILE, FAILED_PART = derived.FAILED_CHUNK
FAIL_MSG = f"ERROR: Simulated failure for {FAILED_FILE}_part{FAILED_PART}"

MODEL_CASE = """CASE event_type WHEN 'view' THEN 'gpt-4o-mini-2024-07-18'
  WHEN 'click' THEN 'gpt-4.1-2025-04-14' WHEN 'purchase' THEN 'o3-2025-04-16'
  WHEN 'signup' THEN 'gpt-4.1-nano-2025-04-14' ELSE '{other}' END"""

MASK = "CASE WHEN {k} IS NULL OR length({k}) < 10 THEN '****' ELSE substr({k}, 1, 10) || '**********' END"


def _lines_cte() -> str:
    i, cid = "i", "cid"
    main = f"""CASE WHEN i % 23 = 0 THEN NULL
      WHEN i % 17 = 0 THEN {fmt(derived.ERR_LINE, i, cid)}
      WHEN i % 19 = 0 THEN {fmt(derived.EMPTY_LINE, i, cid)}
      WHEN i % 37 = 0 THEN {fmt(derived.UNKNOWN_LINE, i, cid)}
      WHEN i % 41 = 0 THEN {fmt(derived.NULL_LINE, i, cid)}
      WHEN i % 13 = 0 THEN {fmt(derived.OK_LINE, i, cid, "ans || '\\n' || alt")}
      ELSE {fmt(derived.OK_LINE, i, cid, 'ans')} END"""
    return f"""
ldocs AS (SELECT doc_id AS i, md5(source || '|' || CAST(doc_id AS VARCHAR)) AS cid,
                 md5('orphan|' || CAST(doc_id AS VARCHAR)) AS orphan,
                 CAST(1 + n_chars % 5 AS VARCHAR) AS ans, CAST(5 - n_chars % 5 AS VARCHAR) AS alt
          FROM documents),
lines_all AS (
  SELECT i AS pos, 0 AS k, {main} AS line FROM ldocs
  UNION ALL SELECT i, 1, CASE WHEN i % 29 = 0 AND i % 23 <> 0 THEN {fmt(derived.OK_LINE, i, cid, "'Score: ' || alt")} END FROM ldocs
  UNION ALL SELECT i, 2, CASE WHEN i % 31 = 0 THEN {fmt(derived.NOID_LINE, i)} END FROM ldocs
  UNION ALL SELECT i, 3, CASE WHEN i % 43 = 0 THEN {fmt(derived.BROKEN_LINE, cid)} END FROM ldocs
  UNION ALL SELECT i, 4, CASE WHEN i % 47 = 0 THEN {fmt(derived.OK_LINE, i, 'orphan', 'ans')} END FROM ldocs),
lines AS (SELECT * FROM lines_all WHERE line IS NOT NULL)"""


def parse_ctes(src: str = "lines", prefix: str = "") -> str:
    """Classification of answer lines held in CTE ``src`` (columns pos, k, line)."""
    p = prefix
    return f"""
{p}vl AS (SELECT pos, k, line FROM {src} WHERE json_valid(line)),
{p}pj AS (SELECT pos, k,
    json_extract_string(line, '$.custom_id') AS cid,
    json_extract(line, '$.response') AS resp,
    json_extract(line, '$.error') AS err,
    json_extract(line, '$.response.body.choices[0].message') AS msg,
    json_extract_string(line, '$.response.body.choices[0].message.content') AS content,
    json_extract_string(line, '$.error.code') AS code,
    json_extract_string(line, '$.error.message') AS emsg
  FROM {p}vl),
{p}pk AS (SELECT *,
    (resp IS NOT NULL AND CAST(resp AS VARCHAR) NOT IN {FALSY}) AS r_t,
    (err IS NOT NULL AND CAST(err AS VARCHAR) NOT IN {FALSY}) AS e_t,
    coalesce(json_type(msg) = 'OBJECT' AND list_contains(json_keys(msg), 'content'), false) AS has_c
  FROM {p}pj),
{p}parsed AS (
  SELECT pos, k, cid AS custom_id,
    CASE WHEN r_t AND NOT e_t AND has_c THEN content
         WHEN r_t AND NOT e_t THEN {lit(R.MALFORMED)}
         WHEN e_t THEN 'Error: ' || coalesce(code, 'N/A') || ' - ' || coalesce(emsg, 'Unknown error')
         ELSE {lit(R.UNKNOWN)} END AS llm_score,
    CASE WHEN r_t AND NOT e_t AND has_c AND content IS NULL THEN 'NullContent'
         WHEN r_t AND NOT e_t AND has_c THEN NULL
         WHEN r_t AND NOT e_t THEN 'Malformed'
         WHEN e_t THEN 'ApiError'
         ELSE 'UnknownStructure' END AS error_type,
    CASE WHEN e_t AND NOT (r_t AND NOT e_t) THEN coalesce(emsg, 'Unknown error') END AS error_message,
    false AS corrupt
  FROM {p}pk
  UNION ALL
  SELECT pos, k, NULL, NULL, 'CorruptLine', NULL, true FROM {src} WHERE NOT json_valid(line))"""


BASE = f"""
ex_raw AS (
  SELECT item_id AS pos, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM benchmark),
ex AS (SELECT pos, line_no, trim(raw, {STRIP}) AS line FROM ex_raw WHERE trim(raw, {STRIP}) <> ''),
sysp AS (SELECT {lit(prompts.GENERIC_PROMPT)} AS sp),
sys AS (SELECT sp, {tok('sp')} AS sys_tok FROM sysp),
exf AS (SELECT CAST(floor(pos / {EXAMPLES_PER_FILE}) AS BIGINT) AS examples_file,
               string_agg('- ' || line, chr(10) ORDER BY pos, line_no) AS block, CAST(count(*) AS BIGINT) AS n_lines
        FROM ex GROUP BY 1),
docs AS (SELECT source AS file, doc_id AS pos, doc_id AS id, text, lang, n_chars,
                md5(source || '|' || CAST(doc_id AS VARCHAR)) AS custom_id FROM documents),
sub AS (
  SELECT d.*, (SELECT sys_tok FROM sys) + {tok(USER + " || coalesce(d.text, 'nan')")} AS tok
  FROM docs d),
ttok AS (SELECT d.*, {tok('d.text')} AS tok FROM docs d),
{_lines_cte().strip()},
{parse_ctes().strip()},
final AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY pos DESC, k DESC) AS rn_
    FROM parsed WHERE custom_id IS NOT NULL AND custom_id <> '') WHERE rn_ = 1),
graded AS (
  SELECT s.*,
    CASE WHEN f.custom_id IS NULL THEN {lit(R.NOT_FOUND)} ELSE coalesce(f.llm_score, {lit(R.FALLBACK)}) END AS llm_score,
    CASE WHEN f.custom_id IS NULL THEN 'NotFound' WHEN f.llm_score IS NULL THEN 'NullContent'
         ELSE f.error_type END AS error_type
  FROM sub s LEFT JOIN final f ON s.custom_id = f.custom_id),
prices(model, p_in, p_out) AS (VALUES {PRICES}),
ev_raw AS (
  SELECT event_id, ts AS timestamp, 'sk-' || CAST(user_id * 7919 AS VARCHAR) AS api_key,
         {MODEL_CASE.format(other='unpriced-model')} AS model,
         {MODEL_CASE.format(other='o1-2024-12-17')} AS strict_model,
         CAST(floor(value) AS BIGINT) AS input_tokens, CAST(event_id % 100 AS BIGINT) AS output_tokens,
         'req-' || CAST(event_id AS VARCHAR) AS request_id
  FROM events),
usage AS (
  SELECT e.request_id, e.timestamp, {MASK.format(k='e.api_key')} AS api_key_prefix, e.model,
         e.input_tokens, e.output_tokens, e.input_tokens + e.output_tokens AS total_tokens,
         coalesce(round((e.input_tokens * p.p_in + e.output_tokens * p.p_out) / 1000000.0, 6), 0.0) AS cost
  FROM ev_raw e LEFT JOIN prices p ON e.model = p.model),
dlog AS (
  SELECT CAST(timestamp AS DATE) AS date, {MASK.format(k='api_key')} AS api_key_prefix,
         CAST(sum(input_tokens) AS BIGINT) AS tokens_submitted
  FROM ev_raw GROUP BY 1, 2),
forced AS (SELECT g.*, ntile({PARAMS['forced_k']}) OVER (PARTITION BY file ORDER BY pos) AS part FROM graded g)
"""


def with_base(body: str) -> str:
    return "WITH RECURSIVE " + BASE.strip() + ",\n" + body.strip()


def greedy(name: str, src: str, groups: list[str], vals: list[str], limits: list[int],
           row_limit: int | None) -> str:
    """Recursive next-fit walk over ``src`` (groups, pos, vals): CTE ``name`` (groups, pos, part)."""
    g = ", ".join(groups)
    gsel = ", ".join(f"g.{c}" for c in groups)
    gjoin = " AND ".join(f"g.{c} = w.{c}" for c in groups)
    v0 = ", ".join(f"{v} AS c{i}" for i, v in enumerate(vals))
    over = [f"w.c{i} + g.{v} > {lim}" for i, (v, lim) in enumerate(zip(vals, limits))]
    if row_limit is not None:
        over.append(f"w.r >= {row_limit}")
    cond = " OR ".join(over)
    cs = ", ".join(f"CASE WHEN {cond} THEN g.{v} ELSE w.c{i} + g.{v} END" for i, v in enumerate(vals))
    return f"""
{name}_in AS (SELECT {g}, pos, {', '.join(vals)}, row_number() OVER (PARTITION BY {g} ORDER BY pos) AS rn FROM {src}),
{name}_w({g}, rn, pos, part, {', '.join(f'c{i}' for i in range(len(vals)))}, r) AS (
  SELECT {g}, rn, pos, 1, {v0.replace(' AS c', ' AS c')}, 1 FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT {gsel}, g.rn, g.pos, CASE WHEN {cond} THEN w.part + 1 ELSE w.part END, {cs},
         CASE WHEN {cond} THEN 1 ELSE w.r + 1 END
  FROM {name}_w w JOIN {name}_in g ON {gjoin} AND g.rn = w.rn + 1),
{name} AS (SELECT {g}, pos, CAST(part AS BIGINT) AS part FROM {name}_w)"""


SQL: dict[str, str] = {}
# Mean of the files' submitted tokens.
CAP = "(SELECT CAST(floor(avg(t)) AS BIGINT) FROM (SELECT sum(tok) AS t FROM sub GROUP BY file))"
DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
D_RANGE_A, D_RANGE_B = PARAMS["range"]
RANGE = f"CAST(timestamp AS DATE) BETWEEN DATE '{D_RANGE_A}' AND DATE '{D_RANGE_B}'"

# ---- sources ---------------------------------------------------------------
SQL["src_csv"] = DOCS
SQL["src_json"] = DOCS
SQL["src_jsonl"] = DOCS
SQL["src_dispatch"] = DOCS
SQL["src_dir_union"] = ("SELECT doc_id, text, lang, source, n_chars, CASE WHEN lang = 'en' THEN 'csv' "
                        "WHEN lang IN ('fr', 'de') THEN 'json' ELSE 'jsonl' END AS fmt FROM documents")

_PRICE_SCAN = """,
plist(model, p_in, p_out) AS (VALUES {values})
SELECT e.{mcol} AS model, p.p_in AS input_price, p.p_out AS output_price, CAST(count(*) AS BIGINT) AS n_events
FROM ev_raw e LEFT JOIN plist p ON e.{mcol} = p.model GROUP BY 1, 2, 3"""
_strict_prices = [r for r in PRICE_LIST if r[0] != "gpt-4o-mini-2024-07-18"] + [
    ("gpt-4o-mini-2024-07-18", "0.15", "0.60")]
_lenient_prices = [r for r in PRICE_LIST if r[0] != "gpt-4.1-2025-04-14"] + [
    ("gpt-4.1-2025-04-14", "2.00", "8.00")]


def _vals(rows):
    return ", ".join(f"({lit(m)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in rows)


SQL["pricing_strict"] = with_base("x AS (SELECT 1)" + _PRICE_SCAN.format(values=_vals(_strict_prices),
                                                                        mcol="strict_model"))
SQL["pricing_lenient"] = with_base("x AS (SELECT 1)" + _PRICE_SCAN.format(values=_vals(_lenient_prices),
                                                                         mcol="model"))

_USAGE_COLS = ("SELECT request_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ts, api_key_prefix, model, "
               "input_tokens, output_tokens, total_tokens, cost FROM usage")
SQL["usage_events_scan"] = with_base("x AS (SELECT 1) " + _USAGE_COLS)
SQL["usage_append"] = SQL["usage_events_scan"]
SQL["daily_log_scan"] = with_base(
    "x AS (SELECT 1) SELECT strftime(date, '%Y-%m-%d') AS date, api_key_prefix, tokens_submitted FROM dlog")
SQL["examples_scan"] = with_base("x AS (SELECT 1) SELECT line FROM ex")
SQL["responses_scan"] = with_base("x AS (SELECT 1) SELECT custom_id, llm_score, error_type, corrupt FROM parsed")
SQL["error_file_scan"] = with_base(
    "x AS (SELECT 1) SELECT custom_id, llm_score, error_message FROM parsed "
    "WHERE error_type = 'ApiError' AND custom_id IS NOT NULL AND custom_id <> ''")

# ---- sinks -------------------------------------------------------------------
SQL["sink_roundtrip"] = with_base("x AS (SELECT 1) SELECT file, pos, id, text, llm_score, tok FROM graded")
SQL["chunk_sink_roundtrip"] = with_base(
    "x AS (SELECT 1) SELECT file, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(sum(n_chars) AS BIGINT) AS n_chars FROM forced GROUP BY 1, 2")
SQL["daily_usage_upsert"] = with_base("""
lo AS (SELECT CAST(timestamp AS DATE) AS date, {m} AS api_key_prefix, sum(input_tokens) AS t
       FROM ev_raw WHERE timestamp < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
hi AS (SELECT CAST(timestamp AS DATE) AS date, {m} AS api_key_prefix, sum(input_tokens) AS t
       FROM ev_raw WHERE timestamp >= TIMESTAMP '2024-01-10' GROUP BY 1, 2)
SELECT strftime(date, '%Y-%m-%d') AS date, api_key_prefix, CAST(sum(t) AS BIGINT) AS tokens_submitted
FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi) GROUP BY 1, 2""".format(m=MASK.format(k="api_key")))
SQL["rejects_sink"] = with_base(f"""
x AS (SELECT 1)
SELECT file, 'admission' AS stage,
       'Total submitted tokens (' || CAST(sum(tok) AS VARCHAR) || ') exceeds the allowed cap of ' || CAST({CAP} AS VARCHAR) AS error
FROM sub GROUP BY file HAVING sum(tok) > {CAP}""")

# ---- projections -------------------------------------------------------------
SQL["row_id"] = with_base("x AS (SELECT 1) SELECT file, pos, custom_id FROM docs")
_ALL_TURNS = "SELECT 'conv' || CAST(conv_id AS VARCHAR) AS file, turn AS pos FROM conversations"
SQL["id_normalise"] = (f"SELECT source AS file, doc_id AS pos, CAST(doc_id AS VARCHAR) AS custom_id FROM documents "
                       f"UNION ALL SELECT file, pos, md5(file || '|' || CAST(pos AS VARCHAR)) FROM ({_ALL_TURNS})")
SQL["id_restore"] = f"SELECT file, pos, md5(file || '|' || CAST(pos AS VARCHAR)) AS id FROM ({_ALL_TURNS})"
SQL["drop_internal"] = "SELECT source AS file, doc_id AS pos, lang FROM documents"
SQL["user_prompt"] = (f"SELECT source AS file, doc_id AS pos, {USER} || coalesce(text, 'nan') AS user_message "
                      "FROM documents")
SQL["examples_block"] = with_base("x AS (SELECT 1) SELECT examples_file, block, n_lines FROM exf")
SQL["system_prompt"] = with_base(f"""
filled AS (SELECT examples_file, replace({lit(prompts.TEMPLATE_WITH_EXAMPLES)}, '{{dynamic_examples}}', block) AS system_prompt
           FROM exf)
SELECT examples_file, system_prompt, {tok('system_prompt')} AS system_tokens FROM filled""")


def _request_json(cid: str, text: str) -> str:
    user = f"{USER} || coalesce({text}, 'nan')"
    return (f"CAST(json_object('custom_id', {cid}, 'method', 'POST', 'url', {lit(prompts.DEFAULT_ENDPOINT)}, "
            f"'body', json_object('model', {lit(prompts.DEFAULT_MODEL)}, 'messages', json_array("
            f"json_object('role', 'system', 'content', (SELECT sp FROM sys)), "
            f"json_object('role', 'user', 'content', {user})), 'max_tokens', {prompts.DEFAULT_MAX_TOKENS})) AS VARCHAR)")


SQL["build_requests"] = with_base(f"x AS (SELECT 1) SELECT custom_id, {_request_json('custom_id', 'text')} AS request FROM docs")
SQL["request_bytes"] = with_base(
    f"x AS (SELECT 1) SELECT custom_id, CAST(strlen({_request_json('custom_id', 'text')}) AS BIGINT) "
    "AS n_bytes FROM docs")
SQL["request_sink_roundtrip"] = with_base(f"""
x AS (SELECT 1)
SELECT file || '_part' || CAST(part AS VARCHAR) AS chunk_id, CAST(count(*) AS BIGINT) AS n_requests,
       CAST(sum(strlen({_request_json('custom_id', 'text')})) AS BIGINT) AS n_bytes,
       CAST(count(DISTINCT custom_id) AS BIGINT) AS n_ids
FROM (SELECT d.*, ntile({PARAMS['forced_k']}) OVER (PARTITION BY file ORDER BY pos) AS part FROM docs d) GROUP BY 1""")
SQL["row_text"] = ("SELECT source AS file, doc_id AS pos, concat_ws(' ', CAST(doc_id AS VARCHAR), text, lang, source, "
                   "CAST(n_chars AS VARCHAR)) AS row_text FROM documents")
SQL["mask_key"] = with_base(f"x AS (SELECT 1) SELECT DISTINCT api_key, {MASK.format(k='api_key')} AS api_key_prefix FROM ev_raw")
SQL["error_rows"] = with_base("x AS (SELECT 1) SELECT file, pos, llm_score FROM graded WHERE llm_score ILIKE '%error%'")
SQL["row_cap"] = ("SELECT file, pos FROM (SELECT source AS file, doc_id AS pos, row_number() OVER "
                  "(PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= "
                  "(SELECT ceil(avg(n) / 2) FROM (SELECT count(*) AS n FROM documents GROUP BY source))")
SQL["usage_date_range"] = with_base(
    f"x AS (SELECT 1) SELECT request_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day FROM usage WHERE {RANGE}")
SQL["responses_no_id"] = with_base("""
x AS (SELECT 1)
SELECT reason, CAST(count(*) AS BIGINT) AS n_lines FROM (
  SELECT CASE WHEN corrupt THEN 'corrupt' WHEN custom_id IS NULL THEN 'missing_id'
              WHEN custom_id = '' THEN 'empty_id' END AS reason FROM parsed) WHERE reason IS NOT NULL GROUP BY 1""")

_HYB = (f"hf AS (SELECT t.*, ntile({PARAMS['hybrid_k']}) OVER (PARTITION BY file ORDER BY pos) AS fpart FROM ttok t),\n"
        f"hs AS (SELECT file, fpart FROM hf GROUP BY 1, 2 HAVING sum(tok) > {PARAMS['chunk_tokens']}),\n"
        "hflag AS (SELECT h.* FROM hf h JOIN hs USING (file, fpart)),"
        + greedy("hg", "hflag", ["file", "fpart"], ["tok"], [PARAMS["chunk_tokens"]], None) + ",\n"
        "hyb AS (SELECT h.file, h.pos, CAST(h.fpart AS BIGINT) AS part, g.part AS split_part "
        "FROM hf h LEFT JOIN hg g ON h.file = g.file AND h.pos = g.pos)")
SQL["chunk_names"] = with_base(_HYB + """
SELECT file, pos, CASE WHEN split_part IS NULL THEN file || '_part' || CAST(part AS VARCHAR)
  ELSE file || '_part' || CAST(part AS VARCHAR) || '_split_part' || CAST(split_part AS VARCHAR) END AS chunk_id FROM hyb""")
SQL["chunk_hybrid"] = with_base(_HYB + "\nSELECT file, pos, part, split_part FROM hyb")

# ---- scalar functions ----------------------------------------------------------
SQL["tokens_regex"] = f"SELECT doc_id, {tok('text')} AS tokens FROM documents"
SQL["tokens_chars4"] = "SELECT doc_id, CAST(coalesce(ceil(length(text) / 4), 0) AS BIGINT) AS tokens FROM documents"
SQL["submitted_tokens"] = with_base("x AS (SELECT 1) SELECT file, pos, tok FROM sub")
SQL["chunking_tokens"] = with_base(
    "x AS (SELECT 1) SELECT source AS file, doc_id AS pos, "
    + tok("(SELECT sp FROM sys) || chr(10) || concat_ws(' ', CAST(doc_id AS VARCHAR), text, lang, source, "
          "CAST(n_chars AS VARCHAR))") + " AS tok FROM documents")
SQL["completion_tokens"] = with_base(f"x AS (SELECT 1) SELECT file, pos, {TOK_SCORE} AS output_tokens FROM graded")
SQL["extract_content"] = with_base(
    "x AS (SELECT 1) SELECT pos, k, custom_id, llm_score FROM parsed WHERE error_type IS NULL")
SQL["classify_responses"] = with_base(
    "x AS (SELECT 1) SELECT pos, k, custom_id, llm_score, error_type, error_message, corrupt FROM parsed")
_FORM = r"'^\s*(?:[Ss]core:\s*)?([0-9]+)\s*$'"
_SCORE = (f"CASE WHEN TRY_CAST(regexp_extract({{c}}, {_FORM}, 1) AS INTEGER) BETWEEN 1 AND 5 "
          f"THEN TRY_CAST(regexp_extract({{c}}, {_FORM}, 1) AS INTEGER) END")
SQL["parse_score"] = with_base(f"x AS (SELECT 1) SELECT custom_id, CASE WHEN error_type IS NULL THEN "
                               f"{_SCORE.format(c='llm_score')} END AS score FROM final")
SQL["parse_score_multi"] = with_base(f"""
ml AS (SELECT custom_id, unnest(string_split(llm_score, chr(10))) AS line,
              generate_subscripts(string_split(llm_score, chr(10)), 1) AS line_no FROM final WHERE llm_score IS NOT NULL)
SELECT custom_id, CAST(line_no AS BIGINT) AS line_no, {_SCORE.format(c='line')} AS score FROM ml""")

# ---- joins ---------------------------------------------------------------------
SQL["join_results"] = with_base("x AS (SELECT 1) SELECT file, pos, llm_score, error_type FROM graded")
SQL["cost_strict"] = with_base("""
x AS (SELECT 1)
SELECT e.request_id, e.strict_model AS model,
       (e.input_tokens / 1000000.0) * p.p_in + (e.output_tokens / 1000000.0) * p.p_out AS cost
FROM ev_raw e JOIN prices p ON e.strict_model = p.model""")
SQL["cost_lenient"] = with_base("x AS (SELECT 1) SELECT request_id, model, cost FROM usage")
SQL["chunk_error_rows"] = with_base(f"""
x AS (SELECT 1)
SELECT file, pos, CAST(part AS BIGINT) AS part,
  CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN {lit(FAIL_MSG)} ELSE llm_score END AS llm_score,
  CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN 'failed' ELSE 'completed' END AS chunk_status
FROM forced""")
SQL["unanswered"] = with_base(
    "x AS (SELECT 1) SELECT file, pos, custom_id FROM docs d WHERE NOT EXISTS "
    "(SELECT 1 FROM final f WHERE f.custom_id = d.custom_id)")
SQL["orphan_answers"] = with_base(
    "x AS (SELECT 1) SELECT custom_id, llm_score FROM final f WHERE NOT EXISTS "
    "(SELECT 1 FROM docs d WHERE d.custom_id = f.custom_id)")
SQL["tokens_remaining"] = with_base(f"""
look AS (SELECT DISTINCT CAST(timestamp AS DATE) + 1 AS date, {MASK.format(k='api_key')} AS api_key_prefix FROM ev_raw)
SELECT CAST(l.date AS VARCHAR) AS date, l.api_key_prefix, CAST(coalesce(d.tokens_submitted, 0) AS BIGINT) AS used,
       CAST({PARAMS['daily_limit']} - coalesce(d.tokens_submitted, 0) AS BIGINT) AS remaining
FROM look l LEFT JOIN dlog d ON l.date = d.date AND l.api_key_prefix = d.api_key_prefix""")
SQL["batch_status_rows"] = with_base(f"""
x AS (SELECT 1)
SELECT file, pos, file || '_part' || CAST(part AS VARCHAR) AS chunk_id,
  CASE WHEN file = 'src2' AND part = 2 THEN '{R.STATUS_PREFIX}expired'
       WHEN file = 'src3' AND part = 1 THEN '{R.STATUS_PREFIX}failed'
       WHEN file = 'src4' AND part = 3 THEN {lit(R.NO_OUTPUT)}
       WHEN file = 'src5' AND part = 3 THEN {lit(R.UNREADABLE)}
       ELSE llm_score END AS llm_score
FROM forced""")
SQL["answered_rows"] = with_base(
    "x AS (SELECT 1) SELECT file, pos FROM docs d WHERE EXISTS (SELECT 1 FROM final f WHERE f.custom_id = d.custom_id)")

# ---- aggregations --------------------------------------------------------------
_STATS = """SELECT file, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(tok) AS BIGINT) AS total_tokens,
       round(avg(tok), 6) AS avg_tokens, CAST(max(tok) AS BIGINT) AS max_tokens FROM {src} GROUP BY file"""
SQL["count_tokens_report"] = with_base("x AS (SELECT 1) " + _STATS.format(src="sub"))
SQL["token_stats"] = with_base("x AS (SELECT 1) " + _STATS.format(src="ttok"))
_GREEDY_TEXT = greedy("gt", "ttok", ["file"], ["tok"], [PARAMS["chunk_tokens"]], PARAMS["chunk_rows"])
_TOTALS = """SELECT {keys}, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(tok) AS BIGINT) AS chunk_tokens,
       min(pos) AS first_pos, max(pos) AS last_pos FROM {src} GROUP BY {keys}"""
SQL["chunk_totals"] = with_base(_GREEDY_TEXT.strip() + ",\nj AS (SELECT t.tok, g.* FROM gt g JOIN ttok t USING (file, pos))\n"
                                + _TOTALS.format(keys="file, part", src="j"))
SQL["chunk_greedy"] = with_base(_GREEDY_TEXT.strip() + "\nSELECT g.file, g.pos, t.tok, g.part FROM gt g JOIN ttok t USING (file, pos)")
SQL["file_token_totals"] = with_base(
    f"x AS (SELECT 1) SELECT file, CAST(sum(tok) AS BIGINT) AS input_tokens, "
    f"CAST(sum({TOK_SCORE}) AS BIGINT) AS output_tokens FROM graded GROUP BY file")
_SUMS = "CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, CAST(count(*) AS BIGINT) AS count"
SQL["usage_total"] = with_base(
    f"x AS (SELECT 1) SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, "
    f"round(coalesce(sum(cost), 0.0), 6) AS total_cost, CAST(count(*) AS BIGINT) AS count FROM usage WHERE {RANGE}")
SQL["usage_by_day"] = with_base(f"x AS (SELECT 1) SELECT strftime(timestamp, '%Y-%m-%d') AS key, {_SUMS} FROM usage GROUP BY 1")
SQL["usage_by_model"] = with_base(f"x AS (SELECT 1) SELECT model AS key, {_SUMS} FROM usage GROUP BY 1")
SQL["usage_all"] = with_base(f"x AS (SELECT 1) SELECT 'all' AS key, {_SUMS} FROM usage")
_GSETS = """SELECT CASE grouping(day, model) WHEN 1 THEN 'day' WHEN 2 THEN 'model' ELSE 'all' END AS grouping,
       coalesce(day, model, 'all') AS key, {sums}
FROM (SELECT *, strftime(timestamp, '%Y-%m-%d') AS day FROM usage {where})
GROUP BY GROUPING SETS ((day), (model), ())"""
SQL["usage_grouping_sets"] = with_base("x AS (SELECT 1) " + _GSETS.format(sums=_SUMS, where=""))
SQL["total_cost"] = with_base(f"x AS (SELECT 1) SELECT round(coalesce(sum(cost), 0.0), 6) AS total_cost FROM usage WHERE {RANGE}")
SQL["daily_submitted"] = with_base(
    "x AS (SELECT 1) SELECT CAST(date AS VARCHAR) AS date, api_key_prefix, tokens_submitted FROM dlog")
SQL["usage_for_day"] = with_base(f"""
look AS (SELECT DISTINCT CAST(timestamp AS DATE) - 1 AS date, {MASK.format(k='api_key')} AS api_key_prefix FROM ev_raw)
SELECT CAST(l.date AS VARCHAR) AS date, l.api_key_prefix, CAST(coalesce(d.tokens_submitted, 0) AS BIGINT) AS tokens_submitted
FROM look l LEFT JOIN dlog d ON l.date = d.date AND l.api_key_prefix = d.api_key_prefix""")

_SCORED = f"""
fr AS (SELECT s.*, ntile({PARAMS['forced_k']}) OVER (PARTITION BY file ORDER BY pos) AS part,
              CAST(1 + length(coalesce(text, 'nan')) % 5 AS VARCHAR) AS answer FROM sub s),
cst AS (
  SELECT file, CAST(part AS BIGINT) AS part,
    CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN {lit(FAIL_MSG)} END AS error_message,
    CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN NULL ELSE CAST(sum(tok) AS BIGINT) END AS input_tokens,
    CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN CAST(0 AS BIGINT)
         ELSE CAST(sum({tok('answer')}) AS BIGINT) END AS output_tokens
  FROM fr GROUP BY file, part),
cstc AS (SELECT c.*, CASE WHEN status = 'completed' THEN
           round((input_tokens * (SELECT p_in FROM prices WHERE model = '{prompts.DEFAULT_MODEL}')
                  + output_tokens * (SELECT p_out FROM prices WHERE model = '{prompts.DEFAULT_MODEL}'))
                 / 1000000.0, 6) END AS cost
         FROM cst c)"""
SQL["job_summary"] = with_base(_SCORED.strip() + """
SELECT CAST(count(*) AS BIGINT) AS total_jobs, CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed,
       CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errored,
       CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
       CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
       round(coalesce(sum(cost), 0.0), 6) AS cost FROM cstc""")
SQL["score_chunks"] = with_base(_SCORED.strip() + """
SELECT file, part, status, error_message, input_tokens, output_tokens FROM cst""")
_POLICY = _SCORED.strip() + f""",
pol AS (SELECT file, pos, CAST(part AS BIGINT) AS part,
          CASE WHEN file = '{FAILED_FILE}' AND part = {FAILED_PART} THEN {lit(FAIL_MSG)} ELSE answer END AS llm_score
        FROM fr)"""
SQL["policy_continue"] = with_base(_POLICY + "\nSELECT file, pos, part, llm_score FROM pol")
SQL["policy_halt"] = with_base(_POLICY + f"""
SELECT file, pos, part, llm_score FROM pol
WHERE NOT (file = '{FAILED_FILE}' AND part >= {FAILED_PART})""")

# ---- grade (L1) and what is computed from it --------------------------------
_GRADE = greedy("gg", "sub", ["file"], ["tok"], [PARAMS["chunk_tokens"]], 50_000) + f""",
gr AS (
  SELECT s.file, s.pos, s.id, s.file || '_part' || CAST(g.part AS VARCHAR) AS chunk_id,
    CASE WHEN s.file = '{FAILED_FILE}' AND g.part = {FAILED_PART} THEN {lit(FAIL_MSG)}
         ELSE CAST(1 + length(coalesce(s.text, 'nan')) % 5 AS VARCHAR) END AS llm_score,
    CASE WHEN s.file = '{FAILED_FILE}' AND g.part = {FAILED_PART} THEN 'Chunk:failed' END AS error_type,
    s.tok AS input_tokens
  FROM sub s JOIN gg g USING (file, pos)),
grade AS (SELECT *, coalesce(llm_score ILIKE '%error%', false) AS is_error,
                 {tok("coalesce(llm_score, '')")} AS output_tokens FROM gr)"""
SQL["grade"] = with_base(_GRADE.strip() + "\nSELECT file, pos, id, chunk_id, llm_score, error_type, is_error, "
                         "input_tokens, output_tokens FROM grade")
SQL["file_error_counts"] = with_base(
    _GRADE.strip() + "\nSELECT file, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS n_errors FROM grade GROUP BY file")
SQL["grade_usage"] = with_base(_GRADE.strip() + f"""
SELECT file, 'sk-inkmete**********' AS api_key_prefix, '{prompts.DEFAULT_MODEL}' AS model,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens,
  round((sum(input_tokens) * (SELECT p_in FROM prices WHERE model = '{prompts.DEFAULT_MODEL}')
       + sum(output_tokens) * (SELECT p_out FROM prices WHERE model = '{prompts.DEFAULT_MODEL}')) / 1000000.0, 6) AS cost
FROM grade GROUP BY file""")
SQL["grade_job"] = with_base(f"""
x AS (SELECT 1),
run AS (SELECT file, tok, {tok("CAST(1 + length(coalesce(text, 'nan')) % 5 AS VARCHAR)")} AS output_tokens
        FROM sub WHERE file <= '{JOB_FAILED_FILE}'),
waves AS (SELECT file, (row_number() OVER (ORDER BY file) - 1) // {JOB_WAVE_FILES} AS wave FROM (SELECT DISTINCT file FROM sub))
SELECT 'result' AS kind, file AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(tok) AS BIGINT) AS tokens FROM run GROUP BY file
UNION ALL
SELECT 'usage', 'file:' || file, 1, CAST(sum(tok) + sum(output_tokens) AS BIGINT) FROM run
WHERE file <> '{JOB_FAILED_FILE}' GROUP BY file
UNION ALL
SELECT 'daily', '2024-02-01|sk-inkmete**********', 1, CAST(sum(tok) AS BIGINT) FROM sub
WHERE file IN (SELECT file FROM waves WHERE wave <= (SELECT wave FROM waves WHERE file = '{JOB_FAILED_FILE}'))""")
SQL["grade_files"] = with_base(f"""
fg AS (SELECT s.*, CASE WHEN lang = 'en' THEN 'csv' WHEN lang IN ('fr', 'de') THEN 'json' ELSE 'jsonl' END
                   || '|' || file || '|' || CAST(floor(pos / {ID_BLOCK}) AS VARCHAR) AS infile FROM sub s)
SELECT pos AS doc_id, CAST(1 + length(coalesce(text, 'nan')) % 5 AS VARCHAR) AS llm_score,
       CAST(NULL AS VARCHAR) AS error_type, tok AS input_tokens,
       {tok("CAST(1 + length(coalesce(text, 'nan')) % 5 AS VARCHAR)")} AS output_tokens
FROM fg""")
SQL["files_all_failed"] = with_base(_GRADE.strip() + "\nSELECT file, bool_and(is_error) AS all_failed FROM grade GROUP BY file")

# ---- packing, gates -----------------------------------------------------------------
SQL["chunk_forced"] = ("SELECT source AS file, doc_id AS pos, CAST(ntile(3) OVER (PARTITION BY source ORDER BY doc_id) "
                       "AS BIGINT) AS part FROM documents")
SQL["chunk_rows"] = (f"SELECT source AS file, doc_id AS pos, CAST(floor((row_number() OVER (PARTITION BY source "
                     f"ORDER BY doc_id) - 1) / {PARAMS['rows_per_chunk']}) + 1 AS BIGINT) AS part FROM documents")
SQL["split_gate"] = with_base(
    f"x AS (SELECT 1) SELECT file, CAST(sum(tok) AS BIGINT) AS total_tokens, sum(tok) > {CAP} "
    "AS needs_split FROM sub GROUP BY file")
_ADMIT = """SELECT file, CAST(sum(tok) AS BIGINT) AS total_tokens, CAST(count(*) AS BIGINT) AS n_rows,
  CASE WHEN sum(tok) > {cap} THEN 'rejected' ELSE 'admitted' END AS status,
  CAST(CASE WHEN sum(tok) > {cap} THEN 0 ELSE sum(tok) END AS BIGINT) AS logged_tokens FROM sub GROUP BY file"""
SQL["admission_cap"] = with_base("x AS (SELECT 1) " + _ADMIT.format(cap=CAP))
SQL["halt_prefix"] = with_base(f"""
adm AS ({_ADMIT.format(cap=CAP)})
SELECT file, status = 'rejected' AS failed,
       coalesce(sum(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING
                AND 1 PRECEDING), 0) = 0 AS processed
FROM adm""")
SQL["pack_requests"] = with_base(
    f"rq AS (SELECT s.*, CAST(strlen({_request_json('s.custom_id', 's.text')}) AS BIGINT) AS req_bytes "
    "FROM sub s),"
    + greedy("pk2", "rq", ["file"], ["tok", "req_bytes"], [PARAMS["pack_tokens"], PARAMS["pack_bytes"]], 50_000)
    + "\nSELECT file, pos, part FROM pk2")
SQL["dedupe_last"] = with_base("x AS (SELECT 1) SELECT custom_id, llm_score, error_type FROM final")
SQL["budget_admission"] = with_base(f"""
per AS (SELECT file, CAST(sum(tok) AS BIGINT) AS total_tokens FROM sub GROUP BY file)
SELECT file, total_tokens, CAST(sum(total_tokens) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens,
       sum(total_tokens) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING)
         <= (SELECT floor(sum(total_tokens) / 2) FROM per) AS admitted
FROM per""")

# ---- order / sets ------------------------------------------------------------------
SQL["ordered_results"] = with_base("x AS (SELECT 1) SELECT file, pos, llm_score FROM graded")
SQL["union_chunks"] = with_base(f"""
x AS (SELECT 1)
SELECT file, pos, CAST(part AS BIGINT) AS part, llm_score, NULL AS error_message FROM forced
WHERE NOT (file = '{FAILED_FILE}' AND part = {FAILED_PART})
UNION ALL
SELECT file, pos, CAST(part AS BIGINT), NULL, {lit(FAIL_MSG)} FROM forced WHERE file = '{FAILED_FILE}' AND part = {FAILED_PART}""")

# ---- UDF surface ----------------------------------------------------------------------
SQL["custom_counter"] = with_base(
    "wd AS (SELECT d.*, CAST(len(string_split(text, ' ')) AS BIGINT) AS tok FROM docs d),"
    + greedy("gw", "wd", ["file"], ["tok"], [PARAMS["word_limit"]], None)
    + ",\nj AS (SELECT w.tok, g.* FROM gw g JOIN wd w USING (file, pos))\n" + _TOTALS.format(keys="file, part", src="j"))
SQL["score_rows"] = with_base(r"""
feat AS (SELECT custom_id, pos, ln(1 + n) AS x1, length(t) / greatest(n, 1)::DOUBLE AS x2 FROM (
  SELECT custom_id, pos, coalesce(text, 'nan') AS t, len(regexp_extract_all(coalesce(text, 'nan'), '[^\x20\x09-\x0D]+')) AS n FROM docs)),
mom AS (SELECT avg(y) AS y, avg(x1) AS a, avg(x2) AS b, var_pop(x1) AS aa, var_pop(x2) AS bb, covar_pop(x1, x2) AS ab,
               covar_pop(x1, y) AS ay, covar_pop(x2, y) AS by_
        FROM (SELECT x1, x2, CAST(quality AS DOUBLE) AS y FROM feat JOIN labels ON feat.pos = labels.doc_id WHERE quality IS NOT NULL)),
w AS (SELECT y, a, b, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS w1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS w2 FROM mom)
SELECT custom_id, CAST(1 + least(4, greatest(0, CAST(floor(5 * round(y - w1 * a - w2 * b + w1 * x1 + w2 * x2, 9)) AS BIGINT))) AS VARCHAR) AS llm_score
FROM feat, w""")

# ---- jobs -----------------------------------------------------------------------------
SQL["split_report"] = with_base(f"""
gate AS (SELECT file, sum(tok) > {CAP} AS needs_split FROM sub GROUP BY file),
sp_in AS (SELECT s.* FROM sub s JOIN gate USING (file) WHERE needs_split),""" + greedy(
    "sg", "sp_in", ["file"], ["tok"], [PARAMS["chunk_tokens"]], None) + f""",
parts AS (SELECT s.file, s.pos, s.tok, coalesce(g.part, 1) AS part FROM sub s LEFT JOIN sg g USING (file, pos))
SELECT t.*, gate.needs_split FROM ({_TOTALS.format(keys='file, part', src='parts')}) t JOIN gate USING (file)""")
SQL["costs_report"] = with_base(f"""
lastday AS (SELECT max(CAST(timestamp AS DATE)) AS d FROM usage)
SELECT *, 'all_time' AS scope FROM ({_GSETS.format(sums=_SUMS, where='')})
UNION ALL
SELECT *, 'latest_day' AS scope FROM ({_GSETS.format(sums=_SUMS, where='WHERE CAST(timestamp AS DATE) = (SELECT d FROM lastday)')})""")

# ---- streaming (batch equivalents) --------------------------------------------------
SQL["stream_usage_daily"] = with_base(
    f"x AS (SELECT 1) SELECT strftime(timestamp, '%Y-%m-%d') AS day, model, {_SUMS} FROM usage GROUP BY 1, 2")
SQL["stream_daily_quota"] = SQL["daily_submitted"]
SQL["stream_responses"] = SQL["dedupe_last"]
SQL["stream_expired"] = f"""
SELECT md5(source || '|' || CAST(doc_id AS VARCHAR)) AS custom_id,
  CASE WHEN doc_id % 23 <> 0 AND doc_id % 30 <= 24 THEN 'answered' ELSE 'batch_expired' END AS status,
  CASE WHEN doc_id % 23 <> 0 AND doc_id % 30 <= 24 THEN CAST(1 + n_chars % 5 AS VARCHAR)
       ELSE {lit('Error: batch_expired - Batch expired before the request was processed')} END AS llm_score
FROM documents"""

SQL["pack_pages"] = with_base(
    "pg AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS file, page_id AS pos, "
    "CAST(coalesce(ceil(length(html) / 4), 0) AS BIGINT) AS tok FROM pages),"
    + greedy("gp", "pg", ["file"], ["tok"], [PARAMS["chunk_tokens"]], None)
    + ",\nj AS (SELECT p.tok, g.* FROM gp g JOIN pg p USING (file, pos))\n" + _TOTALS.format(keys="file, part", src="j"))
SQL["count_tokens_conversations"] = with_base(
    "cv AS (SELECT 'conv' || CAST(conv_id AS VARCHAR) AS file, turn AS pos, "
    "(SELECT sys_tok FROM sys) + " + tok(USER + " || coalesce(text, 'nan')") + " AS tok "
    "FROM conversations WHERE role = 'assistant')\n" + _STATS.format(src="cv"))

SQL["sink_versioned"] = """
SELECT run_ts, CAST(count(*) AS BIGINT) AS n_rows FROM documents,
  (VALUES ('20240101T000000'), ('20240102T000000')) AS r(run_ts) GROUP BY run_ts"""
SQL["score_concurrency"] = """
SELECT file, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_answers, 'completed' AS status
FROM (SELECT source AS file, ntile(3) OVER (PARTITION BY source ORDER BY doc_id) AS part FROM documents) GROUP BY 1, 2"""
