"""Independent DuckDB SQL for every registered query (the correctness oracle).

The fixture CTE renders the same inputs as ``sources.fixtures`` from the raw
tables; each query then computes its expected result either by re-running the
operator's logic in SQL or, where RE2 lacks the needed regex features, by
round trip from the source rows the input was rendered from.
"""

from __future__ import annotations

# --- fixed values, written out here so that a wrong one in the engine shows ----
DEFAULT_SYSTEM = 'You are a helpful assistant with access to the following functions. Use them if required -'
TAGGED = r"<functioncall>\s*(\{.*?\})"
NAME_ARGS = r'(\{"name":\s*"[^"]+",\s*"arguments":\s*\{.*?\}\s*\})'
FLAT_NAME = r'(\{[^{}]*"name"[^{}]*\})'
WHOLE = "whole-text"
PROFILES = {"pairs": (TAGGED, NAME_ARGS, FLAT_NAME), "metrics": (TAGGED, NAME_ARGS, FLAT_NAME, WHOLE),
            "inference": (NAME_ARGS, FLAT_NAME)}
NO_FUNCTIONS_PROMPT = "You are a helpful assistant."
SYSTEM_PREFIX = "You are a helpful assistant that calls functions when appropriate.\nAvailable functions:\n\n"
CALL_INSTRUCTION = (
    "\nWhen calling a function respond ONLY with valid JSON in this exact format:\n"
    '{"name": "<function_name>", "arguments": {<key>: <value>, ...}}\n'
    "Do not include any explanation or extra text."
)
TOOL_PREFIX = "[FUNCTION RESPONSE]: "
HALLUCINATED_NAMES = (
    "send_email",
    "play_music",
    "control_device",
    "access_database",
    "delete_file",
    "call_contact",
    "print_document",
    "take_screenshot",
)
HALLUCINATED_ARGUMENTS = '{"query": "example", "target": "user"}'
STRATEGIES = ("wrong_function", "wrong_params", "missing_params", "hallucinate")
# One fixture schema as json.dumps(..., indent=2) lays it out inside a list; NAME stands for the tool.
PRETTY_SCHEMA = """  {
    "name": "NAME",
    "description": "Record a NAME event",
    "parameters": {
      "type": "object",
      "properties": {
        "user": {
          "type": "string",
          "description": "User handle"
        },
        "k": {
          "type": "integer",
          "description": "Event key"
        },
        "urgent": {
          "type": "boolean"
        },
        "tags": {
          "type": "array",
          "items": {
            "type": "string"
          }
        }
      },
      "required": [
        "user",
        "k"
      ]
    }
  }"""
# --------------------------------------------------------------------------------


def lit(s: str) -> str:
    """A DuckDB expression for a Python string (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def h(*parts: str) -> str:
    """stable_hash in DuckDB: first 8 hex digits of md5(concat_ws('|', ...))."""
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


def first(col: str, pattern: str) -> str:
    return f"nullif(regexp_extract({col}, {lit('(?s)' + pattern)}, 1), '')"


def valid(x: str) -> str:
    return f"coalesce(json_valid({x}), false)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def parse_call(col: str, profile: str) -> str:
    branches = []
    for p in PROFILES[profile]:
        if p == WHOLE:
            w = strip(col)
            branches.append(f"CASE WHEN {valid(w)} AND json_type({w}) = 'OBJECT' "
                            f"AND list_contains(json_keys({w}), 'name') THEN {w} END")
        else:
            m = first(col, p)
            branches.append(f"CASE WHEN {valid(m)} THEN {m} END")
    return "coalesce(" + ", ".join(branches) + ")"


def py_style(x: str) -> str:
    tok = r'"(?:[^"\\]|\\.)*"|[,:]|[^",:\s]+'
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {lit(tok)}), "
            f"lambda t: CASE t WHEN ',' THEN ', ' WHEN ':' THEN ': ' ELSE t END), '')")


def json_str(x: str) -> str:
    return f"to_json(({x})::VARCHAR)"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda q: q <> '')"


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


SCHEMA_TAIL = (' event", "parameters": {"type": "object", "properties": {'
               '"user": {"type": "string", "description": "User handle"}, '
               '"k": {"type": "integer", "description": "Event key"}, '
               '"urgent": {"type": "boolean"}, '
               '"tags": {"type": "array", "items": {"type": "string"}}}, '
               '"required": ["user", "k"]}}')

FIXTURE = f"""
tc_tools AS (
  SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS tool_idx, name,
         '{{"name": "' || name || '", "description": "Record a ' || name || {lit(SCHEMA_TAIL)} AS schema_json
  FROM (SELECT DISTINCT event_type AS name FROM events WHERE event_type IS NOT NULL)
),
tc_n AS (SELECT count(*) AS n, least(3, count(*)) AS m FROM tc_tools),
tc_picks AS (SELECT t.tool_idx AS residue, unnest(range(tc_n.m)) AS i FROM tc_tools t CROSS JOIN tc_n),
tc_windows AS (
  SELECT p.residue, list(w.name ORDER BY p.i) AS tool_names, list(w.schema_json ORDER BY p.i) AS schemas
  FROM tc_picks p CROSS JOIN tc_n JOIN tc_tools w ON w.tool_idx = (p.residue + p.i) % tc_n.n
  GROUP BY p.residue
),
tc_ev AS (
  SELECT e.event_id, e.user_id, e.event_type AS name, e.value, json_extract_string(e.props, '$.k') AS k, t.tool_idx
  FROM events e JOIN tc_tools t ON t.name = e.event_type
),
tc_calls AS (
  SELECT *, '{{"name": "' || name || '", "arguments": ' ||
    CASE WHEN event_id % 5 = 4 THEN '{{}}'
         WHEN event_id % 5 = 3 THEN '{{"user": "user_' || user_id || '"}}'
         ELSE '{{"user": "user_' || user_id || '", "k": ' || k || ', "urgent": ' ||
              CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ||
              ', "tags": ["t' || (event_id % 3) || '", "x"]}}' END || '}}' AS call_json
  FROM tc_ev
),
tc_allowed AS (SELECT c.*, w.tool_names AS allowed_functions FROM tc_calls c JOIN tc_windows w ON w.residue = c.tool_idx),
tc_conv AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
    (c.role = 'assistant' AND (c.conv_id + c.turn) % 3 = 1 AND k.event_id IS NOT NULL) AS injected,
    CASE WHEN c.conv_id % 2 = 0 THEN '{{"name": "' || k.name || '", "arguments": "none"}}' ELSE k.call_json END AS inj_call
  FROM conversations c LEFT JOIN tc_calls k ON k.event_id = c.conv_id * 10 + c.turn
),
tc_lines AS (
  SELECT conv_id, turn, role = 'system' AS is_sys,
    CASE WHEN role = 'user' THEN 'USER: ' || text
         WHEN injected THEN 'ASSISTANT: <functioncall> ' || inj_call || ' </s>' || chr(10) || 'FUNCTION RESPONSE: {{"ok": true}}'
         WHEN role = 'assistant' THEN 'ASSISTANT: ' || text || ' </s>'
         WHEN role = 'system' THEN text END AS line
  FROM tc_conv
),
tc_dialogues AS (
  SELECT l.conv_id AS example_id,
    'SYSTEM: ' || coalesce(nullif(coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE is_sys), ''), ''), {lit(DEFAULT_SYSTEM)})
      || chr(10) || array_to_string(w.schemas, chr(10)) AS system,
    coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE NOT is_sys), '') AS chat,
    w.schemas, w.tool_names
  FROM tc_lines l CROSS JOIN tc_n JOIN tc_windows w ON w.residue = l.conv_id % tc_n.n
  WHERE line IS NOT NULL
  GROUP BY l.conv_id, w.schemas, w.tool_names
),
tc_turns0 AS (
  SELECT conv_id AS example_id, turn, 0 AS sub, role,
         CASE WHEN injected THEN '<functioncall> ' || inj_call ELSE {strip('text')} END AS content
  FROM tc_conv WHERE role IN ('user', 'assistant') AND (text IS NOT NULL OR injected)
  UNION ALL
  SELECT conv_id, turn, 1, 'tool', '{{"ok": true}}' FROM tc_conv WHERE injected
),
tc_turns AS (
  SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY turn, sub) - 1 AS BIGINT) AS turn_idx,
         role, content, turn
  FROM tc_turns0
),
tc_calls_of AS (
  SELECT conv_id AS example_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS call_idx,
         inj_call AS call, turn
  FROM tc_conv WHERE injected
),
tc_corpus AS (
  SELECT d.example_id, d.schemas, d.tool_names,
    (SELECT count(*) FROM tc_turns t WHERE t.example_id = d.example_id) AS num_turns,
    (SELECT count(*) FROM tc_calls_of c WHERE c.example_id = d.example_id) AS num_calls
  FROM tc_dialogues d
),
tc_eval AS (
  SELECT m.model, a.event_id AS example_id,
    CASE m.model
      WHEN 'base' THEN CASE WHEN a.event_id % 10 <= 5 THEN {{prose}} WHEN a.event_id % 10 <= 7 THEN {{unknown}}
                            WHEN a.event_id % 10 = 8 THEN {{nested}} ELSE a.call_json END
      WHEN 'sft_lora' THEN CASE WHEN a.event_id % 10 = 0 THEN {{prose}} WHEN a.event_id % 10 = 1 THEN {{unknown}}
                                WHEN a.event_id % 10 <= 3 THEN {{shifted}} ELSE '<functioncall> ' || a.call_json || ' </s>' END
      ELSE CASE WHEN a.event_id % 10 = 0 THEN {{prose}} WHEN a.event_id % 10 = 1 THEN {{flipped}} ELSE a.call_json END
    END AS prediction,
    a.call_json AS reference, a.allowed_functions, a.value AS latency_ms
  FROM tc_allowed a CROSS JOIN (VALUES ('base'), ('sft_lora'), ('dpo')) m(model)
),
tc_pair_input AS (
  SELECT event_id AS example_id, 'Request ' || event_id AS prompt,
    CASE WHEN event_id % 11 = 0 THEN 'No tool is needed for request ' || event_id || '.' ELSE call_json END AS completion,
    CASE WHEN event_id % 7 = 0 THEN [name] ELSE allowed_functions END AS available_functions
  FROM tc_allowed
)
"""
_PRED = {
    "prose": "'I could not find a tool for request ' || a.event_id || '.'",
    "unknown": "'<functioncall> {\"name\": \"lookup_' || a.name || '\", \"arguments\": {\"user\": \"user_' || a.user_id || '\"}} </s>'",
    "nested": "'{\"name\": \"' || a.name || '\", \"arguments\": {\"k\": ' || (CAST(a.k AS BIGINT) + 1) || ', \"user\": {\"id\": ' || a.user_id || '}}}'",
    "shifted": "'{\"name\": \"' || a.name || '\", \"arguments\": {\"user\": \"user_' || (a.user_id + 1) || '\", \"k\": ' || (CAST(a.k AS BIGINT) + 1) || '}}'",
    "flipped": "'Sure! {\"name\": \"' || a.name || '\", \"arguments\": {\"user\": \"user_' || a.user_id || '\", \"urgent\": ' || CASE WHEN a.event_id % 2 = 0 THEN 'false' ELSE 'true' END || '}} Done.'",
}
for _k, _v in _PRED.items():
    FIXTURE = FIXTURE.replace("{" + _k + "}", _v)


def with_fixture(body: str) -> str:
    return "WITH RECURSIVE " + FIXTURE.strip() + ",\n" + body


# -- prompt rendering ----------------------------------------------------------

def system_prompt(names: str) -> str:
    one = f"replace({lit(PRETTY_SCHEMA)}, 'NAME', n)"
    body = f"'[' || chr(10) || array_to_string(list_transform({names}, lambda n: {one}), ',' || chr(10)) || chr(10) || ']'"
    return (f"CASE WHEN len({names}) = 0 THEN {lit(NO_FUNCTIONS_PROMPT)} "
            f"ELSE {lit(SYSTEM_PREFIX)} || {body} || {lit(CALL_INSTRUCTION)} END")


def compact_prompt(schemas: str) -> str:
    body = "'[' || array_to_string(list_transform(" + schemas + ", lambda s: " + py_style("s") + "), ', ') || ']'"
    return (f"CASE WHEN len({schemas}) = 0 THEN {lit(NO_FUNCTIONS_PROMPT)} "
            f"ELSE {lit(SYSTEM_PREFIX)} || {body} || {lit(CALL_INSTRUCTION)} END")


def block(role: str, content: str) -> str:
    return f"'<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>'"


def chatml(turn_filter: str, extra_where: str = "") -> str:
    """CTE body: (example_id, text) over tc_corpus with turns passing ``turn_filter``."""
    return f"""
tc_msgs AS (
  SELECT t.example_id, t.turn_idx,
    {block("CASE WHEN t.role = 'tool' THEN 'user' ELSE t.role END",
           "CASE WHEN t.role = 'tool' THEN " + lit(TOOL_PREFIX) + " || t.content ELSE t.content END")} AS b
  FROM tc_turns t JOIN tc_corpus c ON c.example_id = t.example_id
  WHERE ({turn_filter}) {extra_where}
),
tc_text AS (
  SELECT c.example_id,
    {block("'system'", system_prompt("c.tool_names"))}
      || coalesce(chr(10) || (SELECT string_agg(m.b, chr(10) ORDER BY m.turn_idx) FROM tc_msgs m WHERE m.example_id = c.example_id), '')
      || chr(10) AS text
  FROM tc_corpus c
)"""


def _q(body: str) -> str:
    return with_fixture(body)


ORACLE: dict[str, str] = {}

ORACLE["parse_turns"] = _q("x AS (SELECT 1) SELECT example_id, turn_idx, role, content FROM tc_turns")

ORACLE["extract_schemas"] = _q("""x AS (SELECT 1)
SELECT example_id, CAST(generate_subscripts(schemas, 1) - 1 AS BIGINT) AS fn_idx,
       unnest(tool_names) AS function_name, unnest(schemas) AS schema_json
FROM tc_dialogues""")

ORACLE["extract_calls_balanced"] = _q("x AS (SELECT 1) SELECT example_id, call_idx, call FROM tc_calls_of")

_LAZY = f"""lz AS (
  SELECT example_id, turn, {first("'<functioncall> ' || call", r"<functioncall>\s*(\{.*?\})")} AS m FROM tc_calls_of
),
lk AS (
  SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY turn) - 1 AS BIGINT) AS call_idx, m AS call
  FROM lz WHERE {valid('m')}
)"""
ORACLE["extract_calls_lazy"] = _q(_LAZY + " SELECT example_id, call_idx, call FROM lk")

ORACLE["corpus_filter"] = _q("""x AS (SELECT 1)
SELECT example_id, CAST(num_turns AS BIGINT) AS num_turns, CAST(len(schemas) AS BIGINT) AS num_functions,
       CAST(num_calls AS BIGINT) AS num_calls, num_calls > 0 AS has_function_call
FROM tc_corpus WHERE num_calls > 0""")

ORACLE["corpus_head"] = _q("""x AS (SELECT 1)
SELECT example_id, CAST(num_turns AS BIGINT) AS num_turns, num_calls > 0 AS has_function_call
FROM tc_corpus ORDER BY example_id LIMIT 25""")

_SPLIT_H = h("'42'", "'split'", "example_id::VARCHAR")
ORACLE["split_hash"] = _q(f"""x AS (SELECT 1)
SELECT example_id, CASE WHEN {_SPLIT_H}::DOUBLE / 4294967296.0 < 0.05 THEN 'validation' ELSE 'train' END AS split
FROM tc_corpus WHERE num_calls > 0""")

ORACLE["split_hash_lazy"] = _q(_LAZY + f""" SELECT example_id,
  CASE WHEN {_SPLIT_H}::DOUBLE / 4294967296.0 < 0.05 THEN 'validation' ELSE 'train' END AS split FROM lk WHERE call_idx = 0""")


def _feistel() -> str:
    """One way through the network for ``x`` on a rectangle of sides a and b, as nested selects."""
    out = "SELECT *, x % a AS l0, x // a AS r0 FROM walk WHERE step = 0 OR x >= n"
    for r in range(1, 4):
        out = f"SELECT *, (l{r - 1} + {h(chr(39) + '42' + chr(39), repr('permute'), str(r), repr('right'), f'r{r - 1}')}) % a AS l{r} FROM ({out})"
        out = f"SELECT *, (r{r - 1} + {h(chr(39) + '42' + chr(39), repr('permute'), str(r), repr('left'), f'l{r}')}) % b AS r{r} FROM ({out})"
    return out


_EXACT = f"""sn AS (
  SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS i, count(*) OVER () AS n FROM tc_corpus WHERE num_calls > 0
),
sx AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM sn),
walk AS (
  SELECT example_id, n, a, b, i AS x, 0 AS step FROM sx
  UNION ALL SELECT example_id, n, a, b, r3 * a + l3, step + 1 FROM ({_feistel()})
),
sp AS (SELECT example_id, CASE WHEN x < ceil(n * 0.05) THEN 'validation' ELSE 'train' END AS split
  FROM walk WHERE step > 0 AND x < n)"""
ORACLE["split_exact"] = _q(_EXACT + " SELECT example_id, split FROM sp")
ORACLE["corpus_stats"] = _q(_EXACT + " SELECT split, CAST(count(*) AS BIGINT) AS n_rows FROM sp GROUP BY split")

ORACLE["system_prompt"] = _q(f"x AS (SELECT 1) SELECT example_id, {system_prompt('tool_names')} AS system_prompt FROM tc_corpus")
ORACLE["system_prompt_compact"] = _q(f"x AS (SELECT 1) SELECT example_id, {compact_prompt('schemas')} AS system_prompt FROM tc_corpus")

ORACLE["chatml_text"] = _q(chatml("true").strip().rstrip(",") + " SELECT example_id, text FROM tc_text")
ORACLE["eval_prompt"] = _q(chatml("t.role <> 'assistant'") + " SELECT example_id, text FROM tc_text")
ORACLE["pair_prompt"] = _q(chatml("true", "AND t.turn_idx < c.num_turns - 1")
                           + " SELECT c.example_id, CASE WHEN c.num_turns > 1 THEN x.text ELSE '' END AS prompt"
                           + " FROM tc_corpus c JOIN tc_text x ON x.example_id = c.example_id")

_INF_HEAD = f"'<|im_start|>system' || chr(10) || {system_prompt('c.tool_names')} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || t.content || '<|im_end|>' || chr(10)"
ORACLE["inference_prompt"] = _q(f"""x AS (SELECT 1)
SELECT t.example_id, t.turn_idx, {_INF_HEAD} || '<|im_start|>assistant' || chr(10) AS prompt
FROM tc_turns t JOIN tc_corpus c ON c.example_id = t.example_id WHERE t.role = 'user'""")
ORACLE["preview_prompt"] = _q(f"""x AS (SELECT 1)
SELECT t.example_id, t.turn_idx, {_INF_HEAD} || '<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10)
       || '<|im_start|>assistant' || chr(10) AS prompt
FROM tc_turns t JOIN tc_corpus c ON c.example_id = t.example_id WHERE t.role = 'user'""")

ORACLE["select_functions"] = _q("""x AS (SELECT 1)
SELECT tool_idx, name FROM tc_tools
WHERE name IN (SELECT json_extract_string(call, '$.name') FROM tc_calls_of)""")

_CATALOG_PARAMS = "(VALUES (0, 'user', 'string', true), (1, 'k', 'integer', true), (2, 'urgent', 'boolean', false), (3, 'tags', 'array', false)) p(param_idx, param, type, required)"
ORACLE["catalog_params"] = _q(f"""x AS (SELECT 1)
SELECT t.name AS function, CAST(p.param_idx AS BIGINT) AS param_idx, p.param, p.type, p.required
FROM tc_tools t CROSS JOIN {_CATALOG_PARAMS}""")

ORACLE["sample_calls"] = _q("""x AS (SELECT 1)
SELECT name AS function, '{"name": "' || name || '", "arguments": {"user": "example_user", "k": 60, "urgent": true}}' AS call
FROM tc_tools""")

# -- call extraction family (over eval predictions) -----------------------------

ORACLE["extract_call_text"] = _q(f"""x AS (SELECT 1)
SELECT model, example_id, coalesce({first('prediction', TAGGED)}, {first('prediction', NAME_ARGS)}) AS call_text
FROM tc_eval""")
for _prof in ("pairs", "metrics", "inference"):
    ORACLE[f"parse_call_{_prof}"] = _q(
        f"x AS (SELECT 1) SELECT model, example_id, {parse_call('prediction', _prof)} AS call FROM tc_eval")

ORACLE["extraction_status"] = _q(f"""x AS (SELECT model, example_id,
  coalesce({first('prediction', TAGGED)}, {first('prediction', NAME_ARGS)}) AS raw FROM tc_eval)
SELECT model, example_id, CASE WHEN raw IS NULL THEN 'no_call_found' WHEN {valid('raw')} THEN 'valid_call'
  ELSE 'extracted_not_json' END AS status FROM x""")

ORACLE["results_table"] = _q(f"""x AS (SELECT model, example_id, prediction, latency_ms, {parse_call('prediction', 'inference')} AS c FROM tc_eval)
SELECT model, example_id, prediction AS raw_output,
  CASE WHEN c IS NOT NULL THEN json_extract_string(c, '$.name') END AS function_name,
  CASE WHEN c IS NOT NULL THEN {py_style("coalesce(json_extract(c, '$.arguments')::VARCHAR, '{}')")} ELSE '{{}}' END AS arguments,
  round(latency_ms, 1) AS latency_ms, c IS NOT NULL AS valid
FROM x""".replace("'{{}}'", "'{}'"))

# -- scoring --------------------------------------------------------------------

def printed(a: str) -> str:
    """A list or object as str() prints it, but for the quotes: a blank after each comma and colon, None for null."""
    v = f"json_extract({a}, '$.\"' || kk || '\"')::VARCHAR"
    tok = r'"(?:[^"\\]|\\.)*"|[,:]|[^",:\s]+'
    return (f"array_to_string(list_transform(regexp_extract_all({v}, {lit(tok)}), lambda t: CASE WHEN t = ',' THEN ', ' "
            f"WHEN t = ':' THEN ': ' WHEN t[1] = '\"' THEN t ELSE replace(t, 'null', 'None') END), '')")


def _arg_tokens(c: str) -> str:
    a = f"json_extract({c}, '$.arguments')"
    vals = (f"CASE WHEN {c} IS NOT NULL AND json_type({a}) = 'OBJECT' THEN list_transform(json_keys({a}), "
            f"lambda kk: CASE WHEN json_type({a}, '$.\"' || kk || '\"') IN ('ARRAY', 'OBJECT') "
            f"THEN {printed(a)} ELSE coalesce(json_extract_string({a}, '$.\"' || kk || '\"'), 'None') END) ELSE [] END")
    return f"flatten(list_transform({vals}, lambda v: {tokens('v')}))"


_SCORES = f"""s0 AS (
  SELECT model, example_id, prediction, reference, coalesce(allowed_functions, []) AS allowed,
         {parse_call('prediction', 'metrics')} AS pc, {parse_call('reference', 'metrics')} AS rc
  FROM tc_eval
),
s1 AS (
  SELECT *, CASE WHEN pc IS NOT NULL THEN coalesce(json_extract_string(pc, '$.name'), '') END AS pn,
            CASE WHEN rc IS NOT NULL THEN coalesce(json_extract_string(rc, '$.name'), '') END AS rn,
            {_arg_tokens('pc')} AS pt, {_arg_tokens('rc')} AS rt,
            {tokens('prediction')} AS pw, {tokens('reference')} AS rw
  FROM s0
),
s2 AS (
  SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)),
              len(list_filter(rt, lambda x: x = t))))), 0) AS common,
    CASE WHEN len(pw) = 0 OR len(rw) = 0 THEN 0 ELSE
      list_reduce(pw, lambda prev, x: list_reduce(range(1, len(rw) + 1), lambda cur, j: list_append(cur,
        CASE WHEN x = rw[j] THEN prev[j] + 1 ELSE greatest(cur[j], prev[j + 1]) END), [0]),
        list_transform(range(len(rw) + 1), lambda i: 0))[len(rw) + 1] END AS lcs
  FROM s1
),
scores AS (
  SELECT model, example_id,
    pc IS NOT NULL AS valid_json,
    coalesce(pc IS NOT NULL AND rc IS NOT NULL AND pn = rn, false) AS tool_match,
    coalesce(pc IS NOT NULL AND len(allowed) > 0 AND NOT list_contains(allowed, pn), false) AS hallucinated,
    CASE WHEN pc IS NULL OR rc IS NULL THEN 0.0 WHEN len(pt) = 0 AND len(rt) = 0 THEN 1.0
         WHEN len(pt) = 0 OR len(rt) = 0 THEN 0.0 ELSE common / len(pt) END AS precision,
    CASE WHEN pc IS NULL OR rc IS NULL THEN 0.0 WHEN len(pt) = 0 AND len(rt) = 0 THEN 1.0
         WHEN len(pt) = 0 OR len(rt) = 0 THEN 0.0 ELSE common / len(rt) END AS recall,
    CASE WHEN len(pw) = 0 OR len(rw) = 0 OR lcs = 0 THEN 0.0
         ELSE 2.0 * (lcs / len(pw)) * (lcs / len(rw)) / ((lcs / len(pw)) + (lcs / len(rw))) END AS rouge_l
  FROM s2
),
agg AS (
  SELECT model, count(*) AS n,
    100.0 * sum(valid_json::INT) / count(*) AS valid_json_rate,
    100.0 * sum(tool_match::INT) / count(*) AS exact_tool_match_rate,
    100.0 * sum(hallucinated::INT) / count(*) AS hallucination_rate,
    sum(precision) / count(*) AS parameter_precision, sum(recall) / count(*) AS parameter_recall,
    sum(rouge_l) / count(*) AS rouge_l
  FROM scores GROUP BY model
),
metrics AS (
  SELECT model, CAST(n AS BIGINT) AS n, round(valid_json_rate, 2) AS valid_json_rate,
    round(exact_tool_match_rate, 2) AS exact_tool_match_rate,
    round(CASE WHEN parameter_precision + parameter_recall > 0 THEN 2 * parameter_precision * parameter_recall
               / (parameter_precision + parameter_recall) ELSE 0.0 END, 4) AS parameter_f1,
    round(parameter_precision, 4) AS parameter_precision, round(parameter_recall, 4) AS parameter_recall,
    round(hallucination_rate, 2) AS hallucination_rate, round(rouge_l, 4) AS rouge_l
  FROM agg
),
mlong AS (
  SELECT model, metric, value FROM metrics UNPIVOT (value FOR metric IN
    (valid_json_rate, exact_tool_match_rate, parameter_f1, parameter_precision, parameter_recall, hallucination_rate, rouge_l))
),
mwide AS (
  SELECT metric,
    coalesce(max(value) FILTER (WHERE model = 'base'), 0.0) AS base,
    coalesce(max(value) FILTER (WHERE model = 'sft_lora'), 0.0) AS sft_lora,
    coalesce(max(value) FILTER (WHERE model = 'dpo'), 0.0) AS dpo
  FROM mlong GROUP BY metric
)"""

ORACLE["param_pr"] = _q(_SCORES + f" SELECT model, example_id, {r6('precision')} AS precision, {r6('recall')} AS recall FROM scores")
ORACLE["rouge_l"] = _q(_SCORES + f" SELECT model, example_id, {r6('rouge_l')} AS rouge_l FROM scores")
ORACLE["score_examples"] = _q(_SCORES + f""" SELECT model, example_id, valid_json, tool_match, hallucinated,
  {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('rouge_l')} AS rouge_l FROM scores""")
ORACLE["metrics_report"] = _q(_SCORES + " SELECT * FROM metrics")
ORACLE["metrics_long"] = _q(_SCORES + f" SELECT model, metric, {r6('value')} AS value FROM mlong")
_FIVE = "('valid_json_rate', 'exact_tool_match_rate', 'parameter_f1', 'hallucination_rate', 'rouge_l')"
ORACLE["comparison_table"] = _q(_SCORES + f""" SELECT metric, {r6('base')} AS base, {r6('sft_lora')} AS sft_lora,
  {r6('dpo')} AS dpo, {r6('dpo - base')} AS delta FROM mwide WHERE metric IN {_FIVE}""")
ORACLE["kpi_deltas"] = _q(_SCORES + f""" SELECT metric, {r6('dpo')} AS dpo, {r6('dpo - base')} AS delta_vs_base
  FROM mwide WHERE metric IN ('valid_json_rate', 'exact_tool_match_rate', 'hallucination_rate', 'parameter_f1')""")
ORACLE["improvements"] = _q(_SCORES + f""", st AS (
  SELECT metric, 'base_to_sft' AS stage, sft_lora - base AS d FROM mwide UNION ALL
  SELECT metric, 'sft_to_dpo', dpo - sft_lora FROM mwide UNION ALL
  SELECT metric, 'base_to_dpo', dpo - base FROM mwide)
SELECT stage, metric, {r6('d')} AS delta,
  CASE WHEN metric LIKE '%rate' THEN printf('%+.1f pp', round(d, 1)) ELSE printf('%+.3f', round(d, 3)) END AS display
FROM st WHERE metric IN {_FIVE}""")
ORACLE["throughput_report"] = _q("""x AS (SELECT model, count(*) AS n, sum(latency_ms) / 1000.0 AS s FROM tc_eval GROUP BY model)
SELECT model, CAST(n AS BIGINT) AS n, round(s, 1) AS inference_time_s, round(n / s, 1) AS throughput_sps FROM x""")

# -- pairs ----------------------------------------------------------------------

_S = "'42'"


def _pairs_cte() -> str:
    call = "c"
    args = f"json_extract({call}, '$.arguments')"
    keys = f"json_keys({args})"

    def vtype(kk):
        return f"json_type({args}, '$.\"' || {kk} || '\"')"

    def vtext(kk):
        return f"json_extract_string({args}, '$.\"' || {kk} || '\"')"

    def vjson(kk):
        return f"json_extract({args}, '$.\"' || {kk} || '\"')::VARCHAR"

    corrupt = (f"CASE WHEN {vtype('kk')} = 'VARCHAR' AND length({vtext('kk')}) > 3 THEN {json_str('reverse(' + vtext('kk') + ')')}"
               f" WHEN {vtype('kk')} IN ('BIGINT', 'UBIGINT') THEN CAST(-(abs(CAST({vtext('kk')} AS HUGEINT)) + 42) AS VARCHAR)"
               f" WHEN {vtype('kk')} = 'BOOLEAN' THEN CASE WHEN {vtext('kk')} = 'true' THEN '-43' ELSE '-42' END"
               f" WHEN {vtype('kk')} = 'ARRAY' AND json_array_length({vjson('kk')}) > 0 THEN "
               f"to_json(list_reverse(json_extract({args}, '$.\"' || kk || '\"')::JSON[]))::VARCHAR"
               f" ELSE '\"invalid_value\"' END")
    wp_args = f"'{{' || array_to_string(list_transform({keys}, lambda kk: to_json(kk) || ': ' || ({corrupt})), ', ') || '}}'"
    h_mp = h(_S, "'missing_params'", "example_id::VARCHAR", "kk")
    shuffled = f"list_transform(list_sort(list_transform({keys}, lambda kk: {{'h': {h_mp}, 'k': kk}})), lambda s: s.k)"
    kept = f"list_slice({shuffled}, 1, greatest(1, len({keys}) // 2))"
    mp_args = f"'{{' || array_to_string(list_transform({kept}, lambda kk: to_json(kk) || ': ' || {vjson('kk')}), ', ') || '}}'"
    names = "[" + ", ".join(f"'{n}'" for n in HALLUCINATED_NAMES) + "]"
    name_j = f"to_json(json_extract_string({call}, '$.name'))::VARCHAR"
    alts = "list_filter(available_functions, lambda f: f IS DISTINCT FROM json_extract_string(c, '$.name'))"
    order = ("list_sort([" + ", ".join("{'h': " + h(_S, "'order'", "example_id::VARCHAR", repr(s)) + ", 's': " + repr(s) + "}"
                                          for s in STRATEGIES) + "])")
    has_name = f"list_contains(json_keys({call}), 'name')"
    h_wf = h(_S, "'wrong_function'", "example_id::VARCHAR")
    h_hal = h(_S, "'hallucinate'", "example_id::VARCHAR")

    def call_sql(name_sql, args_sql):
        return py_style("'{\"name\": ' || " + name_sql + " || ', \"arguments\": ' || " + args_sql + " || '}'")

    rej_wf = call_sql(f"to_json(({alts})[{h_wf} % len({alts}) + 1])::VARCHAR", f"coalesce({args}::VARCHAR, '{{}}')")
    rej_wp = call_sql(name_j, wp_args)
    rej_mp = call_sql(name_j, mp_args)
    rej_hal = call_sql(f"to_json({names}[{h_hal} % 8 + 1])::VARCHAR", lit(HALLUCINATED_ARGUMENTS))
    is_obj = f"json_type({args}) = 'OBJECT'"
    return f"""p0 AS (SELECT example_id, prompt, completion, available_functions, {parse_call('completion', 'pairs')} AS c
  FROM tc_pair_input),
p1 AS (
  SELECT *, len({alts}) > 0 AS ok_wf,
    coalesce({has_name} AND {is_obj} AND len({keys}) > 0, false) AS ok_wp,
    coalesce({has_name} AND {is_obj} AND len({keys}) >= 2, false) AS ok_mp,
    true AS ok_hal,
    CASE WHEN len({alts}) > 0 THEN {rej_wf} END AS rej_wf,
    CASE WHEN {is_obj} THEN {rej_wp} END AS rej_wp,
    CASE WHEN {is_obj} AND len({keys}) >= 2 THEN {rej_mp} END AS rej_mp,
    {rej_hal} AS rej_hal,
    {order} AS ord
  FROM p0 WHERE c IS NOT NULL
),
p2 AS (
  SELECT *, (list_filter(ord, lambda o: CASE o.s WHEN 'wrong_function' THEN ok_wf WHEN 'wrong_params' THEN ok_wp
      WHEN 'missing_params' THEN ok_mp ELSE ok_hal END))[1].s AS strat
  FROM p1
),
pairs AS (
  SELECT example_id, prompt, completion AS chosen,
    CASE strat WHEN 'wrong_function' THEN rej_wf WHEN 'wrong_params' THEN rej_wp WHEN 'missing_params' THEN rej_mp
      ELSE rej_hal END AS rejected, strat AS rejection_strategy
  FROM p2 WHERE strat IS NOT NULL
)"""


_PAIRS = _pairs_cte()
ORACLE["build_pairs"] = _q(_PAIRS + " SELECT * FROM pairs")
for _s, _short in (("wrong_function", "wf"), ("wrong_params", "wp"), ("missing_params", "mp"), ("hallucinate", "hal")):
    ORACLE[f"pairs_{_s}"] = _q(_PAIRS + f""" SELECT example_id, prompt, completion AS chosen, rej_{_short} AS rejected,
  '{_s}' AS rejection_strategy FROM p1 WHERE ok_{_short} AND rej_{_short} IS NOT NULL""")
ORACLE["pair_distribution"] = _q(_PAIRS + f""", cnt AS (SELECT rejection_strategy, count(*) AS n FROM pairs GROUP BY rejection_strategy)
SELECT rejection_strategy, CAST(n AS BIGINT) AS n_pairs, {r6('n / (SELECT sum(n) FROM cnt)')} AS share FROM cnt
UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT), 1.0 FROM cnt""")

ORACLE["pair_examples"] = _q(chatml("true", "AND t.turn_idx < c.num_turns - 1") + """
SELECT c.example_id, CASE WHEN c.num_turns > 1 THEN x.text ELSE '' END AS prompt,
  (SELECT k.call FROM tc_calls_of k WHERE k.example_id = c.example_id AND k.call_idx = 0) AS completion,
  array_to_string(c.tool_names, ',') AS available_functions
FROM tc_corpus c JOIN tc_text x ON x.example_id = c.example_id WHERE c.num_calls > 0""")

ORACLE["pair_examples_lazy"] = _q(_LAZY + ", " + chatml("true", "AND t.turn_idx < c.num_turns - 1") + """
SELECT c.example_id, CASE WHEN c.num_turns > 1 THEN x.text ELSE '' END AS prompt, k.call AS completion,
  array_to_string(c.tool_names, ',') AS available_functions
FROM tc_corpus c JOIN tc_text x ON x.example_id = c.example_id
JOIN lk k ON k.example_id = c.example_id AND k.call_idx = 0""")

# -- evaluation sample / batch predict / cap length ------------------------------

_REFERENCES = (_EXACT + """ SELECT s.example_id,
  coalesce((SELECT k.call FROM tc_calls_of k WHERE k.example_id = s.example_id AND k.call_idx = 0), '') AS reference,
  array_to_string(c.tool_names, ',') AS allowed_functions
FROM sp s JOIN tc_corpus c ON c.example_id = s.example_id
WHERE s.split = 'validation'""")
ORACLE["reference_calls"] = _q(_REFERENCES)
ORACLE["eval_sample"] = _q(_REFERENCES + " ORDER BY s.example_id LIMIT 1000")

ORACLE["batch_predict"] = _q(_EXACT + """ SELECT s.example_id,
  CASE WHEN len(c.tool_names) > 0 THEN '{"name": "' || c.tool_names[1] || '", "arguments": {}}' ELSE 'no tool' END AS prediction
FROM sp s JOIN tc_corpus c ON c.example_id = s.example_id WHERE s.split = 'validation'""")

ORACLE["cap_length"] = _q(chatml("true") + """, tk AS (
  SELECT example_id, text, list_filter(string_split_regex(text, '\\s+'), lambda q: q <> '') AS toks FROM tc_text)
SELECT example_id, CAST(len(toks) AS BIGINT) AS n_tokens, len(toks) > 64 AS truncated,
  CASE WHEN len(toks) > 64 THEN regexp_extract(text, '^(?:\\s*\\S+){64}') ELSE text END AS text FROM tk""")

ORACLE["cap_length_2048"] = _q(chatml("true") + """, tk AS (
  SELECT example_id, text, list_filter(string_split_regex(text, '\\s+'), lambda q: q <> '') AS toks FROM tc_text),
-- The pattern engine repeats a thousand times at most, so the text is cut three times.
c1 AS (SELECT *, regexp_extract(text, '^(?:\\s*\\S+){1000}') AS p1 FROM tk),
c2 AS (SELECT *, regexp_extract(substr(text, length(p1) + 1), '^(?:\\s*\\S+){1000}') AS p2 FROM c1)
SELECT example_id, CAST(len(toks) AS BIGINT) AS n_tokens, len(toks) > 2048 AS truncated, CASE WHEN len(toks) > 2048
  THEN p1 || p2 || regexp_extract(substr(text, length(p1) + length(p2) + 1), '^(?:\\s*\\S+){48}') ELSE text END AS text FROM c2""")

ORACLE["pack_sequences"] = _q(chatml("true") + """, tk AS (
  SELECT example_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda q: q <> '')) AS BIGINT) AS n_tokens FROM tc_text),
st AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY example_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tk)
SELECT start // 2048 AS bin_id, example_id, CAST(start % 2048 AS BIGINT) AS "offset", n_tokens FROM st""")

ORACLE["compare_models"] = _q(_SCORES + " SELECT * FROM metrics")
ORACLE["metrics_wide"] = _q(_SCORES + " SELECT * EXCLUDE (n) FROM metrics")

_DRAWN = "[" + ", ".join(f"'{s}'" for s in STRATEGIES) + "][" + h(_S, "'choice'", "example_id::VARCHAR") + " % 4 + 1]"
ORACLE["pairs_drawn"] = _q(_PAIRS + f""", drawn AS (SELECT *, {_DRAWN} AS s FROM p1),
dr AS (SELECT example_id, prompt, completion AS chosen, CASE s WHEN 'wrong_function' THEN CASE WHEN ok_wf THEN rej_wf END
    WHEN 'wrong_params' THEN CASE WHEN ok_wp THEN rej_wp END WHEN 'missing_params' THEN CASE WHEN ok_mp THEN rej_mp END
    ELSE rej_hal END AS rejected, s AS rejection_strategy FROM drawn)
SELECT * FROM dr WHERE rejected IS NOT NULL""")

# -- sources and sinks -----------------------------------------------------------

ORACLE["read_dialogues"] = _q("x AS (SELECT 1) SELECT example_id, system, chat FROM tc_dialogues")
_TRAIN = f"CASE WHEN {_SPLIT_H}::DOUBLE / 4294967296.0 < 0.05 THEN 'validation' ELSE 'train' END"
ORACLE["read_corpus"] = _q(f"""x AS (SELECT example_id, {_TRAIN} AS split, CAST(num_turns AS BIGINT) AS num_turns FROM tc_corpus WHERE num_calls > 0)
SELECT * FROM x WHERE split = 'train'""")
ORACLE["read_catalog"] = _q("x AS (SELECT 1) SELECT tool_idx AS function_idx, name, 'Record a ' || name || ' event' AS description FROM tc_tools")
_FEATURES = "'example_id,functions,function_names,turns,function_calls,num_turns,has_function_call,split'"
ORACLE["read_stats"] = _q(f"""x AS (SELECT {_TRAIN} AS split FROM tc_corpus WHERE num_calls > 0)
SELECT split, count(*) AS n_rows, {_FEATURES} AS features FROM x GROUP BY split""")
ORACLE["read_report"] = _q(_SCORES + f" SELECT model, metric, {r6('value')} AS value FROM mlong UNION ALL SELECT model, 'n', n::DOUBLE FROM metrics")
ORACLE["experiment_configs"] = _q(_SCORES + f""" SELECT model, 'rates' AS section, metric AS key, {r6('value')} AS value
FROM mlong WHERE metric IN ('valid_json_rate', 'rouge_l') UNION ALL SELECT model, '', 'examples', n::DOUBLE FROM metrics""")
ORACLE["read_pairs"] = ORACLE["build_pairs"]

ORACLE["metrics_merged"] = ORACLE["metrics_report"]

ORACLE["wall_time"] = """
WITH e AS (SELECT event_type AS model, epoch_ms(ts::TIMESTAMP) AS a, epoch_ms(ts::TIMESTAMP) + round(value * 1000)::BIGINT AS b FROM events),
s AS (SELECT *, max(b) OVER (PARTITION BY model ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e WHERE b > a),
i AS (SELECT *, sum((seen IS NULL OR a > seen)::INT) OVER (PARTITION BY model ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM s),
u AS (SELECT model, sum(len) AS ms FROM (SELECT model, max(b) - min(a) AS len FROM i GROUP BY model, island) GROUP BY model),
c AS (SELECT model, count(*) AS n FROM e GROUP BY model)
SELECT c.model, c.n, round(coalesce(u.ms, 0) / 1000.0, 1) AS busy_s, round(coalesce(c.n / nullif(u.ms / 1000.0, 0), 0.0), 1) AS throughput_sps
FROM c LEFT JOIN u ON c.model IS NOT DISTINCT FROM u.model
"""

ORACLE["head_source_order"] = """
SELECT * FROM (SELECT event_id, event_type, row_number() OVER () - 1 AS row_no FROM events) WHERE row_no < 25
"""
ORACLE["align_positional"] = """
WITH c AS (SELECT conv_id, turn, row_number() OVER () - 1 AS row_no FROM conversations),
e AS (SELECT event_id, row_number() OVER () - 1 AS row_no FROM events)
SELECT row_no, conv_id, turn, event_id FROM c JOIN e USING (row_no)
"""

ORACLE["sft_dataset"] = _q(_EXACT + ", " + chatml("true").strip().rstrip(",")
                           + " SELECT x.example_id, x.text FROM tc_text x JOIN sp ON sp.example_id = x.example_id WHERE sp.split = 'train'")

_CHAIN_INPUT = """, px AS (
  SELECT c.example_id, CASE WHEN c.num_turns > 1 THEN x.text ELSE '' END AS prompt,
    (SELECT k.call FROM tc_calls_of k WHERE k.example_id = c.example_id AND k.call_idx = 0) AS completion, c.tool_names AS available_functions
  FROM tc_corpus c JOIN tc_text x ON x.example_id = c.example_id JOIN sp ON sp.example_id = c.example_id WHERE sp.split = 'train'), """
ORACLE["preference_dataset"] = _q(_EXACT + ", " + chatml("true", "AND t.turn_idx < c.num_turns - 1").strip() + _CHAIN_INPUT
                                  + _PAIRS.replace("FROM tc_pair_input", "FROM px") + " SELECT * FROM pairs")

_EVALUATED = f"""{_EXACT},
ve AS (
  SELECT m.model, s.example_id, CASE WHEN m.model = 'silent' THEN 'no call' WHEN len(c.tool_names) > 0
           THEN '{{"name": "' || c.tool_names[1] || '", "arguments": {{}}}}' ELSE 'no tool' END AS prediction,
    coalesce((SELECT k.call FROM tc_calls_of k WHERE k.example_id = s.example_id AND k.call_idx = 0), '') AS reference,
    c.tool_names AS allowed_functions
  FROM sp s JOIN tc_corpus c ON c.example_id = s.example_id CROSS JOIN (VALUES ('first_tool'), ('silent')) m(model)
  WHERE s.split = 'validation'
),
"""
ORACLE["run_evaluation"] = _q(_EVALUATED + _SCORES.replace("FROM tc_eval\n", "FROM ve\n") + " SELECT * FROM metrics")

ORACLE["refresh_corpus"] = _q("""x AS (SELECT 1)
SELECT example_id, CAST(num_turns AS BIGINT) AS num_turns, CAST(len(schemas) AS BIGINT) AS num_functions,
       CAST(num_calls AS BIGINT) AS num_calls, num_calls > 0 AS has_function_call FROM tc_corpus""")

ORACLE["observations"] = _q(_SCORES + """ SELECT row_number() OVER (ORDER BY model) - 1 AS idx, model || ': ' || n || ' examples' AS observation
FROM metrics""")
ORACLE["experiment_sections"] = _q(_SCORES + """ SELECT 'examples' AS section, model AS key, n::DOUBLE AS value FROM metrics
UNION ALL SELECT 'valid_json', model, valid_json_rate FROM metrics""")
