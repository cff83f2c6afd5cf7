"""SQL building blocks that state the fixtures and operators for the checking engine."""

from __future__ import annotations

from registry.fixtures import DIMENSION, POOL, SEED

WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = r"[A-Za-z_][A-Za-z0-9_./-]*|\p{Nd}+|[^" + WS + "]"


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else repr(value)


CARDS = "cards(m, model, provider, expected, p_in, p_out, context, unit, base, caps) AS (VALUES " + ", ".join(
    "(" + ", ".join(_sql(v) for v in card[:9]) + ", [" + ", ".join(_sql(c) for c in card[9]) + "])" for card in POOL
) + ")"

CARDS_TYPED = f"""{CARDS},
c AS (SELECT m, model, provider, expected::DOUBLE AS expected, p_in::DOUBLE AS p_in, p_out::DOUBLE AS p_out,
             context, unit, base, caps FROM cards)"""

MATRIX = f"""{CARDS_TYPED},
mx AS (
  SELECT doc_id, m, n_chars, doc_id::VARCHAR AS request_id, text, model,
         ((doc_id * 31 + m * 17) % 100) < base - (CASE WHEN lang <> 'en' THEN 15 ELSE 0 END)
           - (CASE WHEN n_chars > 2000 THEN 10 * (3 - m) ELSE 0 END) AS acceptable,
         CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'calibration' ELSE 'test' END AS split,
         CASE WHEN (doc_id + m) % 7 = 0 THEN NULL ELSE n_chars * unit / 1e7 END AS cost_usd,
         lang AS "group",
         ((doc_id * 53 + m * 29 + n_chars) % 50) / 50.0::DOUBLE AS score,
         greatest(1, n_chars // 4) AS input_tokens, 50 + doc_id % 200 AS output_tokens
  FROM documents CROSS JOIN c)"""

MEANS = """means AS (
  SELECT c.model, coalesce(avg(mx.cost_usd), any_value(c.expected)) AS mean_cost
  FROM c LEFT JOIN mx ON mx.model = c.model AND mx.split = 'train' GROUP BY c.model)"""

DIRTY = f"""{MATRIX},
cp AS (SELECT * FROM mx WHERE NOT (doc_id % 23 = 2 AND m = 3)
       UNION ALL SELECT * FROM mx WHERE doc_id % 23 = 1 AND m = 0),
dirty AS (
  SELECT CASE WHEN doc_id % 23 = 11 AND m = 2 THEN '' ELSE request_id END AS request_id,
         CASE WHEN doc_id % 23 = 9 THEN ' ' || chr(10) || ' ' WHEN doc_id % 23 = 3 AND m = 0 THEN text || '!' ELSE text END AS text,
         CASE WHEN doc_id % 23 = 5 AND m = 1 THEN 'ghost/zeta' ELSE model END AS model,
         acceptable,
         CASE WHEN doc_id % 23 = 6 THEN -1.0 WHEN doc_id % 23 = 7 AND m = 1 THEN 'nan'::DOUBLE ELSE cost_usd END AS cost_usd,
         CASE WHEN doc_id % 23 = 4 AND m = 1 THEN 'xx' WHEN doc_id % 23 = 12 THEN '' ELSE "group" END AS "group",
         CASE WHEN doc_id % 23 = 10 THEN 'dev' ELSE split END AS split,
         CASE WHEN doc_id % 23 = 13 AND m = 1 THEN -5 ELSE input_tokens END AS input_tokens,
         CASE WHEN doc_id % 23 = 8 AND m = 2 THEN NULL ELSE output_tokens END AS output_tokens
  FROM cp)"""


def tokens(source: str = "documents", key: str = "doc_id::VARCHAR", text: str = "text") -> str:
    return f"""tok AS (
  SELECT {key} AS request_id,
         list_transform(regexp_extract_all({text}, '{TOKEN}', 0), lambda x: lower(x)) AS t
  FROM {source})"""


TERMS = """trm AS (
  SELECT request_id, len(t) AS n_tokens,
         list_concat(list_concat(list_transform(t, lambda x: 'u:' || x),
           list_transform(range(1, len(t)), lambda i: 'b:' || t[i] || chr(31) || t[i + 1])),
           ['length:' || least(15, len(t) // 64)::VARCHAR]) AS terms
  FROM tok)"""


def features(dimension: int = DIMENSION, seed: str = SEED) -> str:
    return f"""trx AS (SELECT request_id, unnest(terms) AS term FROM trm),
hsh AS (SELECT request_id, sha256('{seed}:' || term) AS h FROM trx),
cnt AS (
  SELECT request_id, (('0x' || substr(h, 1, 16))::UBIGINT % {dimension})::INT AS idx,
         sum(CASE WHEN (('0x' || substr(h, 17, 2))::INT & 1) = 1 THEN 1 ELSE -1 END)::DOUBLE AS n
  FROM hsh GROUP BY 1, 2),
feat AS (
  SELECT request_id, idx, n / sqrt(sum(n * n) OVER (PARTITION BY request_id)) AS v FROM cnt WHERE n <> 0)"""


def text_features(source: str = "documents", key: str = "doc_id::VARCHAR", text: str = "text", **kw) -> str:
    return f"{tokens(source, key, text)},\n{TERMS},\n{features(**kw)}"


def scores(shared: bool = False, keys: str = "SELECT doc_id::VARCHAR AS request_id FROM documents") -> str:
    common = f" + ((idx * 13) % 101 - 50) / 50.0::DOUBLE" if shared else ""
    intercept = " + 0.2::DOUBLE" if shared else ""
    return f"""reqs AS ({keys}),
zs AS (
  SELECT r.request_id, c.model, c.m,
         (c.m - 1) * 0.3::DOUBLE{intercept}
         + coalesce(sum(f.v * (((f.idx * 37 + c.m * 101) % 201 - 100) / 50.0::DOUBLE{common})), 0) AS z
  FROM reqs r CROSS JOIN c LEFT JOIN feat f ON f.request_id = r.request_id
  GROUP BY r.request_id, c.model, c.m),
raw AS (SELECT request_id, model, m, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS raw FROM zs)"""


CALIBRATED = """cal AS (
  SELECT request_id, model, m, raw,
         CASE WHEN raw >= 0.76 THEN round(0.70 + 0.05 * m, 2) WHEN raw >= 0.51 THEN round(0.50 + 0.05 * m, 2)
              WHEN raw >= 0.26 THEN round(0.30 + 0.05 * m, 2) ELSE round(0.10 + 0.05 * m, 2) END::DOUBLE AS p
  FROM raw)"""

REQUESTS = """rq AS (
  SELECT doc_id::VARCHAR AS request_id,
         CASE WHEN doc_id % 3 = 0 THEN 'quality' WHEN doc_id % 3 = 1 THEN 'balanced' ELSE 'cost' END AS mode,
         doc_id % 5 = 0 AS need_tools, doc_id % 7 = 0 AS deny_b, doc_id % 13 = 0 AS only_two,
         CASE WHEN doc_id % 11 = 0 THEN 0.0005::DOUBLE END AS max_cost,
         coalesce(CASE WHEN doc_id % 4 = 1 THEN 0.2::DOUBLE WHEN doc_id % 4 = 2 THEN 0.3::DOUBLE END, 0.1::DOUBLE) AS weight,
         doc_id % 2 = 0 AS override, 0.05::DOUBLE AS drop_, greatest(1, n_chars // 4) AS tin, 50 + doc_id % 200 AS tout
  FROM documents)"""

# Routing over a request table `rq`; `cal` and `means` must be in scope.
ROUTED = """cand AS (
  SELECT rq.*, cal.model, cal.p, c.m,
         CASE WHEN c.p_in IS NOT NULL AND c.p_out IS NOT NULL THEN (tin * c.p_in + tout * c.p_out) / 1000000
              ELSE coalesce(c.expected, means.mean_cost) END AS cost,
         c.provider, c.caps, c.context
  FROM rq JOIN cal USING (request_id) JOIN c ON c.model = cal.model JOIN means ON means.model = c.model),
rej AS (
  SELECT *, list_filter([
      CASE WHEN only_two AND model NOT IN ('small/alpha', 'mid/beta') THEN 'not_allowed' END,
      CASE WHEN deny_b AND provider = 'cloud_b' THEN 'provider_denied' END,
      CASE WHEN need_tools AND NOT list_contains(caps, 'tools') THEN 'missing_capability' END,
      CASE WHEN tin + tout > context THEN 'context_limit' END,
      CASE WHEN max_cost IS NOT NULL AND cost > max_cost THEN 'request_cost_limit' END], lambda x: x IS NOT NULL) AS reasons
  FROM cand),
el AS (SELECT * FROM rej WHERE len(reasons) = 0),
agg AS (
  SELECT rq.*, coalesce(e.n, 0) AS n, e.scale, e.top_p, coalesce(e.beta_ok, false) AS beta_ok FROM rq LEFT JOIN (
    SELECT request_id, count(*) AS n, CASE WHEN max(cost) = 0 THEN 1 ELSE max(cost) END AS scale, max(p) AS top_p,
           bool_or(model = 'mid/beta') AS beta_ok FROM el GROUP BY request_id) e USING (request_id)),
gt AS (
  SELECT *,
    CASE WHEN mode = 'balanced' THEN CASE WHEN weight IN (0.0, 0.02, 0.05, 0.1, 0.2, 0.4) THEN true WHEN weight = 0.8 THEN false END
         WHEN mode = 'quality' THEN true END AS gate,
    CASE WHEN mode = 'balanced' THEN CASE WHEN weight = 0.1 THEN 'frozen_default_policy'
              WHEN weight IN (0.0, 0.02, 0.05, 0.2, 0.4, 0.8) THEN 'calibration_curve_candidate' ELSE 'unevaluated_cost_weight' END
         WHEN mode = 'quality' THEN 'calibration_curve_candidate' ELSE 'unevaluated_cost_mode' END AS scope,
    CASE WHEN mode = 'cost' THEN greatest(0, top_p - drop_) END AS floor_
  FROM agg),
fb AS (
  SELECT *, (gate IS DISTINCT FROM true) AND NOT override AS fallback,
    CASE WHEN n = 0 THEN 'no model satisfies the routing constraints'
         WHEN (gate IS DISTINCT FROM true) AND NOT override AND NOT beta_ok
           THEN 'the policy lacks a passing gate and its fixed fallback is ineligible' END AS error
  FROM gt),
pick AS (
  SELECT f.request_id,
         arg_max(e.model, (e.p, -e.cost, e.model)) AS by_quality,
         arg_max(e.model, (e.p - f.weight * e.cost / f.scale, e.p, -e.cost, e.model)) AS by_balance,
         arg_min(e.model, (e.cost, -e.p, e.model)) FILTER (WHERE e.p >= f.floor_) AS by_cost
  FROM fb f JOIN el e USING (request_id) GROUP BY f.request_id),
dec AS (
  SELECT f.*,
    CASE WHEN error IS NOT NULL THEN NULL WHEN fallback THEN 'mid/beta'
         WHEN mode = 'quality' THEN by_quality WHEN mode = 'balanced' THEN by_balance
         ELSE coalesce(by_cost, by_quality) END AS selected_model
  FROM fb f LEFT JOIN pick USING (request_id))"""

TURNS = """turns AS (
  SELECT conv_id::VARCHAR AS conv_id, turn,
         CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' ELSE role END AS role,
         CASE WHEN role = 'user' AND turn % 4 = 2 THEN '<returncode>' || ((conv_id + turn) % 3)::VARCHAR || '</returncode>' || text
              WHEN role = 'assistant' AND conv_id % 5 = 0 THEN '<think>hidden</think>' || text ELSE text END AS content,
         CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 0
              THEN 'bash({"command":"run ' || turn::VARCHAR || '"})' ELSE '' END AS calls_text
  FROM conversations),
vis AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<think>.*?</think>', '', 'g'),
      '(?is)<(?:reasoning|analysis)>.*?</(?:reasoning|analysis)>', '', 'g'), '(?is)<(?:think|reasoning|analysis)>.*\\z', '', 'g'),
      '^[WS]+|[WS]+\\z', '', 'g') AS visible FROM turns)""".replace("\\\\z", "\\z").replace("WS", WS)


def bounded(column: str, limit: int) -> str:
    marker = len("\n[ROUTER INPUT ELIDED]\n")
    left = (limit - marker) // 2
    return (
        f"CASE WHEN length({column}) <= {limit} THEN {column} ELSE substr({column}, 1, {left}) || chr(10) || "
        f"'[ROUTER INPUT ELIDED]' || chr(10) || right({column}, {limit - marker - left}) END"
    )


NOT_WORD_LEFT = r"(?:^|[^\p{L}\p{M}\p{Nd}_])"
NOT_WORD_RIGHT = r"(?:$|[^\p{L}\p{M}\p{Nd}_])"
CODE_HINT = (
    r"(?i)(```|traceback|exception|error|def |class |function|test_|pytest|\.(?:py|js|ts)"
    + NOT_WORD_RIGHT + r"|git diff|/testbed)"
)
QUESTION_HINT = r"(?i)" + NOT_WORD_LEFT + r"(what|why|how|when|where|which|who)" + NOT_WORD_RIGHT + r"|\?"

PREFIX = f"""{TURNS},
blk AS (
  SELECT *, list_filter([
      CASE WHEN visible <> '' THEN 'RECENT_ROLE_' || upper(role) || chr(10) || {bounded('visible', 2000)} END,
      CASE WHEN calls_text <> '' THEN 'RECENT_TOOL_CALL' || chr(10) || {bounded('calls_text', 1500)} END], lambda x: x IS NOT NULL) AS blocks,
      list_transform(regexp_extract_all(visible, '(?i)<returncode>\\s*(-?\\d+)\\s*</returncode>', 1), lambda x: x::INT <> 0) AS codes,
      length(role) + length(visible) + length(calls_text) AS chars
  FROM vis),
pre AS (
  SELECT a.conv_id, a.turn, count(*) AS message_count,
         sum((b.calls_text <> '')::INT)::BIGINT AS tool_call_count, sum((b.role = 'tool')::INT)::BIGINT AS tool_result_count,
         greatest(1, ceil(sum(b.chars) / 4)::BIGINT) AS approximate_context_tokens,
         coalesce(arg_min(b.visible, b.turn) FILTER (WHERE b.role = 'user'), '') AS first_user,
         flatten(list(b.codes ORDER BY b.turn)) AS codes,
         list(b.blocks ORDER BY b.turn) AS blocks
  FROM blk a JOIN blk b ON a.conv_id = b.conv_id AND b.turn < a.turn
  WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn),
rec AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_index,
         {bounded('first_user', 8000)} AS original,
         array_to_string(flatten(blocks[-6:]), chr(10) || chr(10)) AS joined FROM pre),
prefixes AS (
  SELECT *, {bounded('joined', 8000)} AS recent,
         len(list_filter(codes[-4:], lambda x: x)) AS recent_nonzero_returncodes,
         length(first_user) AS original_request_chars FROM rec),
hinted AS (
  SELECT *, length(recent) AS recent_visible_chars,
         regexp_matches(original || chr(10) || recent, '{CODE_HINT}') AS has_code_hint,
         regexp_matches(original, '{QUESTION_HINT}') AS has_question_hint FROM prefixes),
rendered AS (
  SELECT *, 'ROUTER_METADATA ' || '__step_bucket_' || least(9, step_index // 5)::VARCHAR
      || ' __message_bucket_' || least(15, message_count // 5)::VARCHAR
      || ' __context_bucket_' || least(15, approximate_context_tokens // 2000)::VARCHAR
      || ' __tool_calls_' || least(20, tool_call_count)::VARCHAR || ' __tool_results_' || least(20, tool_result_count)::VARCHAR
      || ' __recent_failures_' || recent_nonzero_returncodes::VARCHAR
      || ' __has_code_' || has_code_hint::INT::VARCHAR || ' __has_question_' || has_question_hint::INT::VARCHAR
      || chr(10) || chr(10) || 'RECENT_VISIBLE_STATE' || chr(10) || recent
      || chr(10) || chr(10) || 'ORIGINAL_USER_REQUEST' || chr(10) || original AS text FROM hinted)"""

# Held-out evaluation in one chain: requests, routing per mode, choices per policy.
def evaluation(modes=("quality", "balanced", "cost")) -> str:
    listed = ", ".join(f"('{mode}')" for mode in modes)
    return f"""{MATRIX},
{MEANS},
{text_features("(SELECT * FROM documents WHERE doc_id % 10 >= 8)")},
{scores(keys="SELECT doc_id::VARCHAR AS request_id FROM documents WHERE doc_id % 10 >= 8")},
{CALIBRATED},
ho AS (
  SELECT mx.request_id, mx.model, mx.acceptable, mx."group", mx.input_tokens AS tin, mx.output_tokens AS tout,
         CASE WHEN c.p_in IS NOT NULL AND c.p_out IS NOT NULL THEN (input_tokens * c.p_in + output_tokens * c.p_out) / 1000000
              ELSE coalesce(c.expected, means.mean_cost) END AS estimate,
         coalesce(mx.cost_usd, estimate) AS cost, cal.p, c.context
  FROM mx JOIN c USING (model) JOIN means USING (model) JOIN cal ON cal.request_id = mx.request_id AND cal.model = mx.model
  WHERE mx.split = 'test'),
md(mode) AS (VALUES {listed}),
oke AS (SELECT * FROM ho CROSS JOIN md WHERE NOT tin + tout > context),
lim AS (SELECT request_id, mode, CASE WHEN max(estimate) = 0 THEN 1 ELSE max(estimate) END AS scale, max(p) AS top_p FROM oke GROUP BY 1, 2),
sel AS (
  SELECT o.request_id, o.mode,
         CASE o.mode WHEN 'quality' THEN arg_max(o.model, (o.p, -o.estimate, o.model))
              WHEN 'balanced' THEN arg_max(o.model, (o.p - 0.1::DOUBLE * o.estimate / l.scale, o.p, -o.estimate, o.model))
              ELSE 'mid/beta' END AS model
  FROM oke o JOIN lim l USING (request_id, mode) GROUP BY o.request_id, o.mode),
choices AS (
  SELECT 'fixed:' || model AS policy, request_id, "group", model AS selected_model, acceptable, cost FROM ho
  UNION ALL SELECT 'router:' || sel.mode, ho.request_id, ho."group", ho.model, ho.acceptable, ho.cost
  FROM sel JOIN ho USING (request_id, model)),
pm AS (
  SELECT policy, count(*) AS requests, sum(acceptable::INT)::BIGINT AS acceptable_count,
         avg(acceptable::INT) AS success_rate, sum(cost) AS total_cost_usd, avg(cost) AS mean_cost_usd
  FROM choices GROUP BY policy),
gr AS (SELECT policy, "group", count(*) AS requests, avg(acceptable::INT) AS rate FROM choices WHERE "group" <> '' GROUP BY 1, 2),
mac AS (SELECT policy, avg(rate) AS macro FROM gr GROUP BY policy),
met AS (SELECT pm.*, mac.macro FROM pm LEFT JOIN mac USING (policy)),
bf AS (
  SELECT arg_max(policy, (coalesce(macro, success_rate), -total_cost_usd, policy)) AS best FROM met WHERE policy LIKE 'fixed:%'),
bfr AS (SELECT met.* FROM met JOIN bf ON met.policy = bf.best)"""


PATTERNS_PRIVATE = (
    r"(?is)<think>.*?</think>",
    r"(?is)<(?:reasoning|analysis)>.*?</(?:reasoning|analysis)>",
    r"(?is)<(?:think|reasoning|analysis)>.*\z",
)
PATTERNS_SECRET = (
    r"\b(?:sk[-_]|tk[-_]|ghp_|github_pat_|tml-)[A-Za-z0-9_-]{16,}\b",
    r"(?i)\bBearer[" + WS + r"]+[A-Za-z0-9._~+/=-]{12,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)\bTINKER_API_KEY[" + WS + r"]*=[" + WS + r"]*[^" + WS + r"]+",
)
OPAQUE = r"[A-Za-z0-9_+/=-]"
