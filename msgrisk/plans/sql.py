"""SQL that gives the result of each registered query on the same tables."""

from __future__ import annotations

from msgrisk import rubric
from msgrisk.plans.views import APP_ID, PROSE_SIGNS, PROSE_TERMS, RUBRIC_SIGNS, RUBRIC_TERMS


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# -- ratings ------------------------------------------------------------------

RATED = """rated AS (
  SELECT l_returnflag AS sheet,
         CASE WHEN l_linenumber <> 7 THEN l_quantity / 10 END AS human,
         l_discount * 50 AS pred
  FROM lineitem)"""

CLEAN = RATED + """, clean AS (
  SELECT sheet, human, pred,
         CAST(round_even(human, 0) AS INTEGER) AS h, CAST(round_even(pred, 0) AS INTEGER) AS p
  FROM rated WHERE human BETWEEN 1 AND 5 AND pred BETWEEN 1 AND 5)"""

LEVELS = "levels AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS k)"

GRID = CLEAN + ", " + LEVELS + """, cells AS (
  SELECT h, p, count(*) AS n FROM clean GROUP BY h, p),
grid AS (
  SELECT a.k AS h, b.k AS p, coalesce(c.n, 0) AS n
  FROM levels a JOIN levels b ON true LEFT JOIN cells c ON c.h = a.k AND c.p = b.k)"""


def _qwk(by: str = "") -> str:
    """CTE ``qwk(group, value)``; ranks are taken among the labels present."""
    g = f"{by}, " if by else ""
    on = f" AND x.{by} = y.{by}" if by else ""
    one = f"{by} AS g" if by else "0 AS g"
    return f"""pairs AS (SELECT {one}, h, p, count(*) AS n FROM clean GROUP BY {g}h, p),
present AS (
  SELECT g, k, dense_rank() OVER (PARTITION BY g ORDER BY k) AS r
  FROM (SELECT g, h AS k FROM pairs UNION SELECT g, p FROM pairs)),
humans AS (SELECT g, h AS k, sum(n) AS n FROM pairs GROUP BY g, h),
preds AS (SELECT g, p AS k, sum(n) AS n FROM pairs GROUP BY g, p),
sizes AS (SELECT g, sum(n) AS n FROM pairs GROUP BY g),
both_ranks AS (
  SELECT a.g, pow(a.r - b.r, 2) AS w, coalesce(c.n, 0) AS n,
         coalesce(t.n, 0) * coalesce(u.n, 0) / CAST(s.n AS DOUBLE) AS e
  FROM present a JOIN present b ON a.g = b.g
  JOIN sizes s ON s.g = a.g
  LEFT JOIN pairs c ON c.g = a.g AND c.h = a.k AND c.p = b.k
  LEFT JOIN humans t ON t.g = a.g AND t.k = a.k
  LEFT JOIN preds u ON u.g = b.g AND u.k = b.k),
qwk AS (SELECT g, 1 - sum(w * n) / nullif(sum(w * e), 0) AS value FROM both_ranks GROUP BY g)"""


def _f1(name: str, h: str, p: str, by: str = "") -> str:
    """CTE ``name(g, macro, weighted)`` for the class expressions h and p."""
    one = by or "0"
    return f"""{name}_rows AS (SELECT {one} AS g, {h} AS h, {p} AS p FROM clean),
{name}_classes AS (SELECT g, h AS k FROM {name}_rows UNION SELECT g, p FROM {name}_rows),
{name}_scores AS (
  SELECT c.g, c.k, count(*) FILTER (r.h = c.k AND r.p = c.k) AS tp,
         count(*) FILTER (r.h = c.k) AS t, count(*) FILTER (r.p = c.k) AS u
  FROM {name}_classes c JOIN {name}_rows r ON r.g = c.g GROUP BY c.g, c.k),
{name} AS (
  SELECT g, avg(2.0 * tp / (t + u)) AS macro,
         sum(2.0 * tp / (t + u) * t) / sum(t) AS weighted
  FROM {name}_scores GROUP BY g)"""


def _cost() -> str:
    rows = [
        f"WHEN h = {i + 1} AND p = {j + 1} THEN {cost}"
        for i, line in enumerate(rubric.COSTS)
        for j, cost in enumerate(line)
    ]
    return "CASE " + " ".join(rows) + " END"


def _rates(by: str = "") -> str:
    one = by or "0"

    def ratio(part: str, whole: str) -> str:
        return (
            f"coalesce(count(*) FILTER ({part})"
            f" / nullif(CAST(count(*) FILTER ({whole}) AS DOUBLE), 0), 0)"
        )

    return f"""rates AS (
  SELECT {one} AS g, count(*) AS n, avg(abs(h - p)) AS mae,
         {ratio("h >= 4 AND p >= 4", "h >= 4")} AS high_risk_recall,
         {ratio("h >= 4 AND p >= 4", "p >= 4")} AS high_risk_precision,
         {ratio("h <= 2 AND p <= 2", "h <= 2")} AS low_risk_recall,
         {ratio("h <= 2 AND p <= 2", "p <= 2")} AS low_risk_precision,
         {ratio("h <= 2 AND p >= 4", "h <= 2")} AS fpr_low_risk,
         avg({_cost()}) AS avg_cost
  FROM clean GROUP BY 1)"""


def _band(value: str) -> str:
    steps = " ".join(f"WHEN {value} >= {floor} THEN {_q(name)}" for floor, name in rubric.QWK_BANDS)
    return f"CASE {steps} ELSE {_q(rubric.QWK_LOWEST_BAND)} END"


def _all_metrics(by: str = "") -> str:
    parts = [
        CLEAN,
        _qwk(by),
        _f1("level_f1", "h", "p", by),
        _f1("high_f1", "CAST(h >= 4 AS INTEGER)", "CAST(p >= 4 AS INTEGER)", by),
        _f1("low_f1", "CAST(h <= 2 AS INTEGER)", "CAST(p <= 2 AS INTEGER)", by),
        _rates(by),
    ]
    record = f"""every AS (
  SELECT r.g, q.value AS qwk, {_band("q.value")} AS qwk_interpretation, r.mae,
         f.weighted AS weighted_f1, f.macro AS macro_f1,
         r.high_risk_recall, r.high_risk_precision,
         hi.macro AS high_risk_macro_f1, hi.weighted AS high_risk_weighted_f1,
         r.low_risk_recall, r.low_risk_precision,
         lo.macro AS low_risk_macro_f1, lo.weighted AS low_risk_weighted_f1,
         r.fpr_low_risk, r.avg_cost, r.n AS total_samples
  FROM rates r JOIN qwk q ON q.g = r.g JOIN level_f1 f ON f.g = r.g
  JOIN high_f1 hi ON hi.g = r.g JOIN low_f1 lo ON lo.g = r.g)"""
    return "WITH " + ",\n".join([*parts, record])


METRIC_NAMES = [
    "qwk", "mae", "weighted_f1", "macro_f1", "high_risk_recall", "high_risk_precision",
    "high_risk_macro_f1", "high_risk_weighted_f1", "low_risk_recall", "low_risk_precision",
    "low_risk_macro_f1", "low_risk_weighted_f1", "fpr_low_risk", "avg_cost",
]


def _metrics(names: list[str], by: str = "", more: str = "") -> str:
    columns = [f"round({n}, 6) AS {n}" for n in names]
    if more:
        columns.append(more)
    if by:
        columns.insert(0, f"g AS {by}")
    return f"{_all_metrics(by)} SELECT {', '.join(columns)} FROM every"


WHOLE_RECORD = "qwk_interpretation, total_samples"


def _verdicts() -> str:
    parts = []
    for name, good, fair, higher in rubric.GRADE_BOUNDS:
        sign = ">=" if higher else "<="
        parts.append(
            f"SELECT {_q(name)} AS metric, round({name}, 6) AS value, "
            f"CASE WHEN {name} {sign} {good} THEN 'good' WHEN {name} {sign} {fair} "
            f"THEN 'fair' ELSE 'poor' END AS grade FROM every"
        )
    return _all_metrics() + " " + " UNION ALL ".join(parts)


def _level_name(column: str) -> str:
    steps = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in rubric.LEVEL_NAMES.items())
    return f"CASE {column} {steps} END"


RATING_SQL = {
    "labels_scan_by_sheet": f"""WITH {RATED}
SELECT sheet, count(*) AS n, count(human) AS n_human, count(pred) AS n_rating
FROM rated GROUP BY sheet""",
    "eval_clean": f"""WITH {CLEAN}
SELECT sheet, round(human, 6) AS "human rating", round(pred, 6) AS rating,
       h AS human_rating_int, p AS rating_int FROM clean""",
    "clean_counts": f"""WITH {RATED}
SELECT sheet, count(*) AS n_raw,
       count(*) FILTER (human IS NOT NULL AND pred IS NOT NULL) AS n_rated,
       count(*) FILTER (human IS NULL OR pred IS NULL) AS n_dropped,
       count(*) FILTER (human BETWEEN 1 AND 5 AND pred BETWEEN 1 AND 5) AS n_valid
FROM rated GROUP BY sheet""",
    "rating_distribution": f"""WITH {CLEAN}
SELECT 'human' AS side, h AS level, count(*) AS n FROM clean GROUP BY h
UNION ALL SELECT 'pred', p, count(*) FROM clean GROUP BY p""",
    "confusion_matrix": f"""WITH {GRID}
SELECT h AS human, p AS pred, n FROM grid""",
    "confusion_norm": f"""WITH {GRID}
SELECT h AS human, p AS pred,
       round(n / nullif(CAST(sum(n) OVER (PARTITION BY h) AS DOUBLE), 0), 6) AS share
FROM grid""",
    "qwk": f"WITH {CLEAN}, {_qwk()} SELECT round(value, 6) AS qwk FROM qwk",
    "qwk_band": f"""WITH {CLEAN}, {_qwk("sheet")}
SELECT g AS sheet, {_band("value")} AS qwk_interpretation FROM qwk""",
    "mae": f"WITH {CLEAN} SELECT round(avg(abs(h - p)), 6) AS mae FROM clean",
    "f1_macro_weighted": _metrics(["macro_f1", "weighted_f1"]),
    "high_risk_pr": _metrics(["high_risk_recall", "high_risk_precision"]),
    "low_risk_rates": _metrics(["fpr_low_risk", "low_risk_recall", "low_risk_precision"]),
    "binary_f1": _metrics([
        "high_risk_macro_f1", "high_risk_weighted_f1", "low_risk_macro_f1", "low_risk_weighted_f1",
    ]),
    "cost_error": _metrics(["avg_cost"]),
    "error_direction": f"""WITH {CLEAN}
SELECT count(*) AS total,
       count(*) FILTER (h = p) AS correct,
       round(count(*) FILTER (h = p) * 100.0::DOUBLE / count(*), 6) AS correct_pct,
       count(*) FILTER (p > h) AS over,
       round(count(*) FILTER (p > h) * 100.0::DOUBLE / count(*), 6) AS over_pct,
       count(*) FILTER (p < h) AS under,
       round(count(*) FILTER (p < h) * 100.0::DOUBLE / count(*), 6) AS under_pct,
       count(*) FILTER (abs(h - p) >= 2) AS severe,
       round(count(*) FILTER (abs(h - p) >= 2) * 100.0::DOUBLE / count(*), 6) AS severe_pct
FROM clean""",
    "level_report": f"""WITH {CLEAN}
SELECT h AS level, {_level_name("h")} AS level_name, count(*) AS n,
       round(avg(CAST(h = p AS INTEGER)), 6) AS accuracy, round(avg(abs(h - p)), 6) AS mae
FROM clean GROUP BY h""",
    "level_pred_dist": f"""WITH {CLEAN}
SELECT h AS human, p AS pred, count(*) AS n,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY h), 6) AS percent
FROM clean GROUP BY h, p""",
    "dist_compare": f"""WITH {CLEAN}, {LEVELS}
SELECT k AS level,
       (SELECT count(*) FROM clean WHERE h = k) AS human_n,
       (SELECT count(*) FROM clean WHERE p = k) AS pred_n FROM levels""",
    "error_hist": f"""WITH {CLEAN}, bins AS (
  SELECT CAST(unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS INTEGER) AS error),
found AS (SELECT p - h AS error, count(*) AS n FROM clean GROUP BY 1)
SELECT b.error, coalesce(f.n, 0) AS n FROM bins b LEFT JOIN found f ON f.error = b.error""",
    "level_accuracy": f"""WITH {CLEAN}, {LEVELS}, found AS (
  SELECT h, avg(CAST(h = p AS INTEGER)) AS a FROM clean GROUP BY h)
SELECT k AS level, round(coalesce(a, 0), 6) AS accuracy FROM levels LEFT JOIN found ON h = k""",
    "eval_summary": _metrics(METRIC_NAMES, more=WHOLE_RECORD),
    "eval_summary_by_sheet": _metrics(METRIC_NAMES, "sheet", WHOLE_RECORD),
    "metrics_json": _metrics(METRIC_NAMES, "sheet", WHOLE_RECORD),
    "eval_verdicts": _verdicts(),
    "dataset_counts": "SELECT source AS dataset, count(*) AS n FROM documents GROUP BY source",
    "label_zip": """WITH a AS (
  SELECT o_orderkey % 3 AS sheet, o_orderpriority AS content, floor(o_totalprice / 50000) / 2 AS human,
         row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) AS r FROM orders),
b AS (
  SELECT event_id % 3 AS sheet, value / 50 AS rating,
         row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS r FROM events)
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.r, b.r) AS row,
       a.content, round(a.human, 6) AS "human rating", round(b.rating, 6) AS rating
FROM a FULL JOIN b ON a.sheet = b.sheet AND a.r = b.r""",
}

# -- chat callbacks -----------------------------------------------------------

CHATS = f"""chats AS (
  SELECT event_id, ts, 'u' || user_id AS from_account,
         'u' || (user_id + 1 + event_id % 3) AS to_account,
         CASE WHEN event_type IN ('view', 'click') THEN 'before'
              WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'other'
              ELSE 'after' END AS kind,
         'msg ' || event_type || ' ' || props AS text,
         CASE WHEN event_id % 7 <> 3 THEN CAST(CAST(trunc(value) AS INTEGER) % 5 + 1 AS DOUBLE)
              END AS rating,
         'seen ' || event_type AS reasoning, props AS advice
  FROM events),
keyed AS (
  SELECT *, least(from_account, to_account) AS account_low,
         greatest(from_account, to_account) AS account_high FROM chats)"""

REQUESTS = CHATS + f""", requests AS (
  SELECT *, event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0 AS readable,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
              WHEN event_id % 19 = 0 THEN 'bad' ELSE {_q(APP_ID)} END AS app,
         ['RESTAPI', 'Web', 'Android', 'iOS', 'Toaster', NULL, 'Unknown'][event_id % 7 + 1]
           AS platform
  FROM chats),
parsed AS (
  SELECT *, CASE WHEN readable AND event_id % 37 <> 0 THEN from_account END AS sender,
         CASE WHEN readable THEN to_account END AS receiver,
         CASE WHEN readable AND event_id % 6 <= 2 THEN text END AS first_text
  FROM requests),
checked AS (
  SELECT *, CASE
      WHEN app IS NULL OR app = '' THEN {_q(rubric.REJECT_NO_APP)}
      WHEN app <> {_q(APP_ID)} THEN {_q(rubric.REJECT_BAD_APP)}
      WHEN platform IS NULL OR platform = 'Toaster' THEN {_q(rubric.REJECT_PLATFORM)}
      WHEN sender IS NULL OR receiver IS NULL THEN {_q(rubric.REJECT_BODY)} END AS error
  FROM parsed)"""


def _template(template: str, *values: str) -> str:
    """Concatenation of a %s template with SQL values."""
    parts = template.split("%s")
    pieces = []
    for part, value in zip(parts, (*values, "")):
        if part:
            pieces.append(_q(part))
        if value:
            pieces.append(value)
    return "(" + " || ".join(pieces).replace("\n", "' || chr(10) || '") + ")"


NOTICE = _template(
    rubric.NOTICE_FORMAT, "reasoning", "CAST(CAST(rating AS BIGINT) AS VARCHAR)", "advice"
)
LAST_MATTERS = """lag(CASE WHEN kind = 'after' AND rating >= 3 THEN {notice} ELSE '' END) OVER
    ({scope} ORDER BY event_id)"""


def _noticed(scope: str) -> str:
    previous = LAST_MATTERS.format(notice=NOTICE, scope=scope)
    return f"""{CHATS}, stateful AS (
  SELECT event_id, nullif(CASE WHEN kind = 'before' THEN {previous} END, '') AS notice
  FROM keyed WHERE kind = 'before' OR (kind = 'after' AND rating IS NOT NULL)),
noticed AS (
  SELECT k.*, s.notice FROM keyed k LEFT JOIN stateful s ON s.event_id = k.event_id)"""


BY_PAIR = "PARTITION BY account_low, account_high"


def _payload() -> str:
    forbid = ", ".join(_q(f) for f in rubric.ALERT_FORBID)
    text = _template(rubric.ALERT_FORMAT, "from_account", NOTICE)
    return f"""CAST(json_object(
  'SyncOtherMachine', {rubric.ALERT_SYNC_MACHINE}, 'To_Account', to_account,
  'MsgRandom', event_id, 'ForbidCallbackControl', [{forbid}],
  'MsgBody', [json_object('MsgType', {_q(rubric.TEXT_ELEMENT)},
                          'MsgContent', json_object('Text', {text}))]) AS VARCHAR)"""


CHAT_SQL = {
    "callback_parse": f"""WITH {REQUESTS}
SELECT event_id, sender AS from_account, receiver AS to_account,
       CASE WHEN readable THEN event_id END AS msg_seq,
       CASE WHEN readable THEN epoch_us(ts) // 1000000 END AS msg_seconds,
       CASE WHEN readable THEN epoch_us(ts) // 1000 END AS event_millis,
       CAST(CASE WHEN readable THEN [1, 2, 2, 1, 0, NULL][event_id % 6 + 1] END AS BIGINT)
         AS n_elements
FROM parsed""",
    "first_text": f"WITH {REQUESTS} SELECT event_id, first_text AS text FROM parsed",
    "callback_validate": f"""WITH {REQUESTS}
SELECT event_id, error AS error_info, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS http
FROM checked""",
    "callback_reject_reasons": f"""WITH {REQUESTS}
SELECT error AS error_info, count(*) AS n FROM checked WHERE error IS NOT NULL GROUP BY 1""",
    "callback_route_counts": f"""WITH {REQUESTS}
SELECT kind, count(*) AS n FROM checked WHERE error IS NULL GROUP BY kind""",
    "conv_key": f"""WITH {REQUESTS}, pairs AS (
  SELECT event_id, CASE WHEN sender IS NOT NULL THEN least(sender, receiver) END AS account_low,
         CASE WHEN sender IS NOT NULL THEN greatest(sender, receiver) END AS account_high
  FROM parsed)
SELECT event_id, account_low, account_high, account_low || '-' || account_high AS conversation
FROM pairs""",
    "action_tier": f"""WITH {CHATS}
SELECT event_id, rating, CASE WHEN kind <> 'after' THEN 'none' WHEN rating >= 4 THEN 'alert' WHEN rating >= 3 THEN 'notice'
       ELSE 'none' END AS tier FROM chats""",
    "advice_tier": f"""WITH {CHATS}
SELECT event_id, CASE WHEN rating >= 5 THEN {_q(rubric.ADVICE["high"])}
       WHEN rating >= 3 THEN {_q(rubric.ADVICE["middle"])}
       WHEN rating >= 1 THEN {_q(rubric.ADVICE["low"])} END AS advice FROM chats""",
    "alert_payload": f"""WITH {CHATS}
SELECT event_id, {_payload()} AS payload FROM chats WHERE kind = 'after' AND rating >= 4""",
    "notice_injection": f"""WITH {_noticed(BY_PAIR)}
SELECT event_id, account_low || '-' || account_high AS conversation, kind, notice,
       notice || chr(10) || text AS message FROM noticed""",
    "notice_injection_global": f"""WITH {_noticed("")}
SELECT event_id, kind, notice FROM noticed""",
    "last3_messages": """WITH numbered AS (
  SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS opens
  FROM conversations WHERE text IS NOT NULL),
lines AS (
  SELECT conv_id, turn, list(role || ': ' || text) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l
  FROM numbered WHERE NOT (text = '' AND opens))
SELECT conv_id, turn, CAST(len(l) AS INTEGER) AS n, array_to_string(l, chr(10)) AS snippet
FROM lines""",
    "last3_chat_events": f"""WITH {CHATS}, lines AS (
  SELECT event_id, account_low || '-' || account_high AS conversation,
         list(from_account || ': ' || text) OVER (
           PARTITION BY account_low, account_high ORDER BY event_id
           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l
  FROM keyed WHERE kind = 'after')
SELECT event_id, conversation, array_to_string(l, chr(10)) AS snippet FROM lines""",
    "last3_one_chat": f"""WITH {CHATS}
SELECT event_id, array_to_string(list(from_account || ': ' || text) OVER (
         ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), chr(10)) AS snippet
FROM chats""",
    "chat_messages": """
SELECT conv_id, turn, lower(role) AS role, coalesce(text, '') AS content
FROM conversations WHERE lower(role) IN ('system', 'user', 'human', 'assistant', 'ai', 'tool')""",
}
ACCEPTED = f"""{REQUESTS}, accepted AS (
  SELECT *, least(sender, receiver) AS account_low, greatest(sender, receiver) AS account_high
  FROM checked WHERE error IS NULL)"""
CHAT_SQL["callback_response"] = f"""WITH {ACCEPTED}, stateful AS (
  SELECT event_id, nullif(CASE WHEN kind = 'before' THEN {LAST_MATTERS.format(
      notice=NOTICE, scope=BY_PAIR)} END, '') AS notice
  FROM accepted WHERE kind = 'before' OR (kind = 'after' AND rating IS NOT NULL))
SELECT c.event_id, CASE WHEN c.error IS NULL THEN 200 ELSE 400 END AS http_status,
       CASE WHEN c.error IS NULL THEN 'OK' ELSE 'FAIL' END AS action_status,
       coalesce(c.error, '') AS error_info,
       CASE WHEN c.error IS NULL THEN 0 ELSE -1 END AS error_code,
       s.notice || chr(10) || coalesce(c.first_text, 'None') AS new_text
FROM checked c LEFT JOIN stateful s ON s.event_id = c.event_id"""
CHAT_SQL["callback_alerts"] = f"""WITH {ACCEPTED}, due AS (
  SELECT * EXCLUDE (from_account, to_account), sender AS from_account, receiver AS to_account
  FROM accepted WHERE kind = 'after' AND rating >= 4)
SELECT event_id, account_low || '-' || account_high AS conversation, {_payload()} AS payload
FROM due"""

# -- links and pages ----------------------------------------------------------

URL_CHARS = "A-Za-z0-9_/\\-"


def _found(text: str, pattern: str, clean: bool) -> str:
    found = f"regexp_extract_all({text}, {_q('(?i)' + pattern)})"
    if clean:
        found = (
            f"list_transform({found}, lambda u: regexp_replace(regexp_replace(u, "
            f"'[^{URL_CHARS}]+$', ''), '[.,;!?。，；！？]+$', ''))"
        )
    return f"list_filter({found}, lambda u: length(u) > 3)"


def _longest_first(urls: str) -> str:
    """Sorted by a key of complement length and value."""
    keyed = f"list_transform(list_distinct({urls}), lambda u: {{'r': -length(u), 'u': u}})"
    return f"list_transform(list_sort({keyed}), lambda k: k.u)"


MAXIMAL = (
    "list_filter({l}, lambda x: len(list_filter({l}, lambda y: y <> x AND contains(y, x))) = 0)"
)
WITH_SCHEME = (
    "list_transform({l}, lambda u: CASE WHEN starts_with(u, 'http://') "
    "OR starts_with(u, 'https://') THEN u ELSE 'https://' || u END)"
)


def _links(table: str, key: str, text: str, pattern: str, clean: bool) -> str:
    """CTEs up to ``links(key, l)``, the finished link list of each row."""
    return f"""sorted AS (
  SELECT {key}, {_longest_first(_found(text, pattern, clean))} AS l FROM {table}),
kept AS (SELECT {key}, {MAXIMAL.format(l="l")} AS l FROM sorted),
links AS (SELECT {key}, {WITH_SCHEME.format(l="l")} AS l FROM kept)"""


MESSAGES = """messages AS (
  SELECT page_id AS msg_id,
         'free: see ' || url || CASE WHEN page_id % 5 = 0 THEN '-gone' ELSE '' END || ' or ' ||
         regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || ', now' AS text FROM pages)"""

MESSAGE_LINKS = MESSAGES + ", " + _links("messages", "msg_id", "text", rubric.URL_FULL, True)


def _key(url: str) -> str:
    bare = (
        f"regexp_replace(regexp_replace(regexp_replace({url}, '^(?i)https?://', ''), "
        f"'#.*$', ''), '/+$', '')"
    )
    host = f"regexp_extract({bare}, '^[^/?]*')"
    return f"lower({host}) || substr({bare}, length({host}) + 1)"


HIDDEN = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![^>]*>"
)
TAG = r"""(?s)</?[A-Za-z](?:[^>"']+|"[^"]*"|'[^']*')*>"""


def _unescaped(text: str) -> str:
    for pattern, value in (
        ("&middot;?", "·"), ("&copy;?", "©"), ("&quot;?", '"'), ("&amp;?", "&"),
    ):
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(value)}, 'g')"
    return text


SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, {_q(f'^{SPACES}+|{SPACES}+$')}, '', 'g')"


PAGE_TEXTS = f"""shown AS (
  SELECT page_id, url, regexp_replace(html, {_q(HIDDEN)}, '', 'g') AS v FROM pages),
phrases AS (
  SELECT page_id, url, v, list_filter(list_transform(flatten(list_transform(
      string_split_regex({_unescaped(f"regexp_replace(v, {_q(TAG)}, '', 'g')")},
                         '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
      lambda s: string_split({_strip("s")}, '  '))),
    lambda c: {_strip("c")}), lambda c: c <> '') AS c
  FROM shown),
full_texts AS (SELECT page_id, url, v, array_to_string(c, ' ') AS t FROM phrases),
texts AS (
  SELECT page_id, url,
         CASE WHEN length(t) > {rubric.PAGE_CHARS}
              THEN substr(t, 1, {rubric.PAGE_CHARS}) || '...' ELSE t END AS content,
         CASE WHEN regexp_matches(v, '(?i)<title\\b') THEN {_strip(_unescaped(
             f"regexp_replace(regexp_extract(v, '(?is)<title[^>]*>(.*?)</title>', 1), {_q(TAG)}, '', 'g')"
         ))} ELSE {_q(rubric.NO_TITLE)} END AS title
  FROM full_texts)"""

# One record per key; of pages with one key the first by url counts.
STORE = PAGE_TEXTS + f""", store AS (
  SELECT k, min_by(title, url) AS title, min_by(content, url) AS content
  FROM (SELECT {_key("url")} AS k, url, title, content FROM texts) GROUP BY k)"""

LINKED = MESSAGE_LINKS + ", " + STORE + f""", flat AS (
  SELECT msg_id, CAST(i - 1 AS INTEGER) AS position, l[i] AS url
  FROM (SELECT msg_id, l, unnest(range(1, len(l) + 1)) AS i FROM links)),
linked AS (
  SELECT f.msg_id, f.position, f.url, s.title, s.content,
         CASE WHEN s.k IS NULL THEN 'error' ELSE 'success' END AS status,
         CASE WHEN s.k IS NULL THEN {_q(rubric.FETCH_FAILED)} || f.url END AS error
  FROM flat f LEFT JOIN store s ON s.k = {_key("f.url")})"""

# The same over a store in which pages with odd numbers came later.
NEWEST_LINKED = (
    LINKED.replace("AS k, url, title", "AS k, (1 - page_id % 2, url) AS turn, title")
    .replace("min_by(title, url)", "min_by(title, turn)")
    .replace("min_by(content, url)", "min_by(content, turn)")
)

PAGE_BLOCK = (
    "CASE WHEN status = 'success' THEN "
    + _template(
        rubric.EVIDENCE_PAGE, "url", "title", f"substr(content, 1, {rubric.EVIDENCE_CHARS})"
    )
    + " ELSE "
    + _template(rubric.EVIDENCE_FAILED, "url", "error")
    + " END"
)


def _evidence(first: str) -> str:
    head = _template(rubric.EVIDENCE_HEAD, "m.text", first)
    return f"""{LINKED}, blocks AS (
  SELECT msg_id, string_agg({PAGE_BLOCK}, '' ORDER BY position) AS b FROM linked GROUP BY msg_id),
documented AS (
  SELECT m.msg_id, m.text, {head} || coalesce(b.b, '') AS document
  FROM messages m LEFT JOIN blocks b ON b.msg_id = m.msg_id)"""


LINK_SQL = {
    "url_extract": f"""WITH {_links("documents", "doc_id", "text", rubric.URL_COMPAT, False)}
SELECT doc_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, ' ') AS urls FROM links""",
    "url_extract_full": f"""WITH {_links("pages", "page_id", "html", rubric.URL_FULL, True)}
SELECT page_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, ' ') AS urls FROM links""",
    "url_maximal": f"""WITH {MESSAGE_LINKS}
SELECT s.msg_id, CAST(len(s.l) AS INTEGER) AS n_found, array_to_string(k.l, ' ') AS kept
FROM sorted s JOIN kept k ON k.msg_id = s.msg_id""",
    "page_text": f"WITH {PAGE_TEXTS} SELECT page_id, content FROM texts",
    "page_title": f"WITH {PAGE_TEXTS} SELECT page_id, title FROM texts",
    "url_page_join": f"""WITH {LINKED}
SELECT msg_id, position, url, title, status, error, CAST(length(content) AS INTEGER) AS n_chars
FROM linked""",
    "page_store_join": f"""WITH {NEWEST_LINKED}
SELECT msg_id, position, url, title, status, error, CAST(length(content) AS INTEGER) AS n_chars
FROM linked""",
    "page_fallback": f"""WITH {LINKED}, seen AS (
  SELECT {_key("url")} AS k, url, content, page_id % 2 = 0 AS a, page_id % 3 = 0 AS b,
         page_id % 5 <> 1 AS c FROM texts),
best AS (
  SELECT k, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c,
         min_by(content, url) FILTER (a) AS ca, min_by(content, url) FILTER (b) AS cb,
         min_by(content, url) FILTER (c) AS cc FROM seen GROUP BY k)
SELECT f.msg_id, f.url, CASE WHEN a OR b OR c THEN 'success' ELSE 'error' END AS status,
       CASE WHEN a THEN 'fetch' WHEN b THEN 'browser' WHEN k IS NOT NULL THEN 'plain' END AS method,
       CAST(length(CASE WHEN a THEN ca WHEN b THEN cb WHEN c THEN cc END) AS INTEGER) AS n_chars
FROM flat f LEFT JOIN best ON k = {_key("f.url")}""",
    "evidence_doc": f"""WITH {_evidence("'first look at ' || m.msg_id")}
SELECT msg_id, document FROM documented""",
}

# -- replies, keywords and scores ---------------------------------------------

REPLIES = """replies AS (
  SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '{"rating": ' || k || ', "advice": "wait"}'
    WHEN 1 THEN '```json' || chr(10) || '{"rating": ' || k || ', "advice": "wait"}' || chr(10)
                || '```'
    WHEN 2 THEN 'I think {"rating": ' || k || '.5, "advice": "wait"} fits'
    WHEN 3 THEN 'rating ' || k
    WHEN 4 THEN '} rating ' || k || ' {'
    WHEN 5 THEN '{"rating": "' || k || '"}'
    WHEN 6 THEN '{"advice": "wait"}'
    ELSE '{"rating": [' || k || ']}' END AS reply
  FROM (SELECT event_id, CAST(CAST(trunc(value) AS INTEGER) % 8 AS VARCHAR) AS k FROM events)),
sliced AS (
  SELECT event_id, reply,
         try_cast(nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') AS JSON) AS j FROM replies)"""


def _matched(terms: list[str]) -> str:
    names = ", ".join(_q(t) for t in terms)
    return f"list_filter([{names}], lambda t: contains(lower(text), t))"


def _score(terms: dict[str, list[str]]) -> str:
    return " + ".join(
        f"{rubric.GROUP_WEIGHTS[g]} * len({_matched(t)})" for g, t in terms.items()
    )


def _level(score: str) -> str:
    steps = " ".join(
        f"WHEN {score} >= {floor} THEN {level}"
        for level, floor in sorted(rubric.LEVEL_FLOORS.items(), reverse=True)
    )
    return f"CASE {steps} ELSE 1 END"


SCORED = f"""scored AS (SELECT doc_id, CAST({_score(PROSE_TERMS)} AS INTEGER) AS score
  FROM documents)"""

KEYWORDS = ", ".join(f"array_to_string({_matched(t)}, ',') AS {g}" for g, t in PROSE_TERMS.items())

TYPED = "typed AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {number} AS k, {_q(rubric.SCAM_TYPES[number - 1])} AS name, "
    f"CAST(len({_matched(terms)}) AS INTEGER) AS hits FROM documents"
    for number, terms in PROSE_SIGNS.items()
) + ")"

ALL_TERMS = [t for terms in PROSE_TERMS.values() for t in terms]

LINK_RATED = LINKED + f""", page_scores AS (
  SELECT msg_id, status, ({_score(PROSE_TERMS).replace("lower(text)", "lower(concat_ws(' ', title, content))")}) >= 4
         AND status = 'success' AS bad FROM linked),
states AS (
  SELECT msg_id, CASE WHEN bool_or(bad) THEN 'suspicious'
         WHEN bool_or(status = 'success') THEN 'clean' ELSE 'unreachable' END AS state
  FROM page_scores GROUP BY msg_id),
judged AS (
  SELECT m.msg_id, coalesce(s.state, 'none') AS state, {_level(f"({_score(PROSE_TERMS)})")} AS level,
         array_to_string({_matched(ALL_TERMS)}, ',') AS keywords
  FROM messages m LEFT JOIN states s ON s.msg_id = m.msg_id)"""



def _pick(values: list[str], number: str) -> str:
    return f"[{', '.join(map(_q, values))}][({number}) % {len(values)} + 1]"


RUBRIC_TEXTS = f"""texts AS (
  SELECT event_id, concat_ws(' ', {_pick(RUBRIC_SIGNS, "event_id")},
         {_pick(RUBRIC_SIGNS, "user_id * 7 + event_id")},
         {_pick(RUBRIC_TERMS, "user_id * 3 + event_id")}, event_type) AS text
  FROM events)"""
RUBRIC_TYPED = "typed AS (" + " UNION ALL ".join(
    f"SELECT event_id, text, {number} AS k, {_q(rubric.SCAM_TYPES[number - 1])} AS name, "
    f"CAST(len({_matched(terms)}) AS INTEGER) AS hits FROM texts"
    for number, terms in rubric.SCAM_SIGNS.items()
) + ")"

STEPS = {k: _q(v) for k, v in rubric.STEP_NAMES.items()}

SCORE_SQL = {
    "verdict_parse": f"""WITH {REPLIES}
SELECT event_id, regexp_replace(regexp_replace(reply, '^```json\\s*', ''), '\\s*```$', '') AS bare,
       CASE WHEN json_type(j -> '$.rating') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
                 AND CAST(j ->> '$.rating' AS DOUBLE) > 0
            THEN CAST(j ->> '$.rating' AS DOUBLE) ELSE 0.0::DOUBLE END AS rating,
       j ->> '$.advice' AS advice
FROM sliced""",
    "reply_content": f"""WITH {REPLIES}
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN reply END AS content FROM replies""",
    "risk_keywords": f"SELECT doc_id, {KEYWORDS} FROM documents",
    "fraud_type": f"""WITH {TYPED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, k) AS r FROM typed)
SELECT doc_id, CASE WHEN hits > 0 THEN name END AS fraud_type, hits FROM ranked WHERE r = 1""",
    "rubric_verdict": f"""WITH {RUBRIC_TEXTS}, {RUBRIC_TYPED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hits DESC, k) AS r FROM typed)
SELECT event_id, CASE WHEN hits > 0 THEN name END AS fraud_type, hits,
       CAST({_score(rubric.RISK_KEYWORDS)} AS INTEGER) AS score FROM ranked WHERE r = 1""",
    "rule_rating": f"""WITH {SCORED}
SELECT doc_id, score, {_level("score")} AS level FROM scored""",
    "link_rating": f"""WITH {LINK_RATED}
SELECT msg_id, state AS link_state, CAST(greatest(1, least(5, level +
         CASE state WHEN 'suspicious' THEN 1 WHEN 'none' THEN 0 ELSE -1 END)) AS DOUBLE) AS rating,
       keywords FROM judged""",
    "terms_tagged": """WITH words AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS term FROM benchmark),
lexicon AS (SELECT term, lower(term) AS low, lower(term[1]) AS grp, length(term) % 3 + 1 AS weight FROM words),
hits AS (SELECT doc_id, term, grp, weight FROM documents JOIN lexicon ON contains(lower(text), low)),
per_group AS (SELECT doc_id, grp, count(*) AS n FROM hits GROUP BY ALL),
lead AS (SELECT doc_id, arg_min(grp, (-n, grp)) AS grp, max(n) AS n FROM per_group GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, sum(weight) AS weight,
                 string_agg(term, ',' ORDER BY grp, term) AS listed FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(f.n, 0) AS INTEGER) AS n_terms, CAST(coalesce(f.weight, 0) AS BIGINT) AS weight,
       md5(coalesce(listed, '')) AS terms_md5, lead.grp AS top_group,
       CAST(coalesce(lead.n, 0) AS INTEGER) AS top_hits
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id LEFT JOIN lead ON lead.doc_id = d.doc_id""",
    "score_batch": """SELECT doc_id,
       CASE WHEN text <> '' AND length(text) % 7 - 1 > 0
            THEN CAST(length(text) % 7 - 1 AS DOUBLE) ELSE 0.0::DOUBLE END AS rating,
       CAST(CASE WHEN text = '' THEN 0 WHEN length(text) % 7 - 1 > 0 THEN 1 ELSE 3 END AS INTEGER)
         AS attempts
FROM documents""",
    "replies_kept": """SELECT doc_id,
       CASE WHEN text <> '' AND length(text) % 7 - 1 > 0
            THEN CAST(length(text) % 7 - 1 AS DOUBLE) ELSE 0.0::DOUBLE END AS rating,
       CAST(CASE WHEN text = '' THEN 0 WHEN length(text) % 7 - 1 > 0 THEN 1 ELSE 3 END AS INTEGER)
         AS attempts, CAST(NULL AS VARCHAR) AS error
FROM documents""",
    "score_conversations": CHAT_SQL["last3_messages"].replace(
        "SELECT conv_id, turn, CAST(len(l) AS INTEGER) AS n, array_to_string(l, chr(10)) AS snippet",
        "SELECT conv_id, turn, CAST(length(array_to_string(l, chr(10))) % 5 + 1 AS DOUBLE) AS rating,"
        " CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS error_message",
    ),
    "workflow_result": f"""WITH {_evidence("length(m.text) || ' characters'")}, staged AS (
  SELECT d.msg_id, d.text, NOT contains(d.text, 'casino') AS one,
         NOT contains(d.document, 'pills') AS two, len(l) > 0 AS linked, length(document) AS n
  FROM documented d JOIN links k ON k.msg_id = d.msg_id)
SELECT msg_id, text AS input_text,
       CASE WHEN NOT one THEN '' ELSE array_to_string(list_filter([{STEPS[1]}, {STEPS[2]},
         CASE WHEN linked THEN {STEPS[3]} END, CASE WHEN two THEN {STEPS[4]} END],
         lambda s: s IS NOT NULL), ',') END AS steps,
       CASE WHEN one AND two THEN '{{"rating": ' || (n % 5 + 1) || '}}' ELSE '' END AS final_analysis,
       CASE WHEN NOT one THEN 'failed' WHEN NOT two THEN 'partial_failure' ELSE 'completed' END
         AS status,
       CASE WHEN NOT one THEN {_q(rubric.STEP_FAILED[1] + "refused")}
            WHEN NOT two THEN {_q(rubric.STEP_FAILED[4] + rubric.EMPTY_REPLY)} END AS error,
       CASE WHEN NOT one THEN 1 WHEN NOT two THEN 4 END AS failed_step
FROM staged""",
    "workflow_ratings": f"""WITH {_evidence("length(m.text) || ' characters'")}, staged AS (
  SELECT d.msg_id, d.text, NOT contains(d.text, 'casino') AS one,
         NOT contains(d.document, 'pills') AS two, len(l) > 0 AS linked, length(document) AS n
  FROM documented d JOIN links k ON k.msg_id = d.msg_id)
SELECT msg_id, CASE WHEN one AND two THEN CAST(n % 5 + 1 AS DOUBLE) ELSE 0.0 END AS rating,
       CASE WHEN NOT one THEN 'refused' END AS error
FROM staged""",
    "conversation_tiers": CHAT_SQL["last3_messages"].replace(
        "SELECT conv_id, turn, CAST(len(l) AS INTEGER) AS n, array_to_string(l, chr(10)) AS snippet\nFROM lines",
        f""", texts AS (SELECT array_to_string(l, chr(10)) AS text FROM lines),
rated AS (SELECT {_level(f"({_score(PROSE_TERMS)})")} AS level FROM texts)
SELECT CAST(level AS DOUBLE) AS rating, CASE WHEN level >= 4 THEN 'alert' WHEN level >= 3
       THEN 'notice' ELSE 'none' END AS tier, count(*) AS n FROM rated GROUP BY level""",
    ),
}

STREAM_SQL = {
    "stream_last_messages": CHAT_SQL["last3_messages"],
    "stream_notices": f"""WITH {_noticed(BY_PAIR)}
SELECT event_id, kind, CASE WHEN kind <> 'after' THEN 'none' WHEN rating >= 4 THEN 'alert'
       WHEN rating >= 3 THEN 'notice' ELSE 'none' END AS tier, notice,
       notice || chr(10) || text AS message FROM noticed""",
    "stream_responses": CHAT_SQL["callback_response"],
    "stream_alerts": CHAT_SQL["alert_payload"],
    "stream_eval_summary": RATING_SQL["eval_summary_by_sheet"],
    "monitor_alerts": f"""WITH {CHATS}, lines AS (
  SELECT event_id, from_account, to_account, list(from_account || ': ' || text) OVER (
           PARTITION BY account_low, account_high ORDER BY event_id
           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l
  FROM keyed WHERE kind = 'after'),
rated AS (
  SELECT *, CAST(length(array_to_string(l, chr(10))) % 5 + 1 AS DOUBLE) AS rating,
         'length' AS reasoning, 'look' AS advice FROM lines)
SELECT event_id, {_payload()} AS payload FROM rated WHERE rating >= 4""",
    "stream_datasets_scored": """SELECT doc_id, 'length' AS model,
       CASE WHEN text <> '' AND length(text) % 7 - 1 > 0
            THEN CAST(length(text) % 7 - 1 AS DOUBLE) ELSE 0.0::DOUBLE END AS rating,
       md5(text) AS content_md5 FROM documents""",
    "workflow_records": SCORE_SQL["workflow_result"].replace("AS failed_step", "AS failed_step, true AS stamped"),
    "tool_calls": """WITH calls AS (
  SELECT conv_id, turn, text, unnest([0, 1, 2, 3]) AS position FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(position AS INTEGER) AS position, 'c' || position AS tool_call_id,
       ['shout', 'reverse', 'length', 'missing'][position + 1] AS name,
       md5(CASE position WHEN 0 THEN text || '!' WHEN 1 THEN reverse(text)
           WHEN 2 THEN CASE WHEN NOT contains(text, 'thth') THEN CAST(json_object(
             'n_chars', length(text), 'head', substr(text, 1, 10)) AS VARCHAR) END END) AS content_md5,
       CASE WHEN position = 2 AND contains(text, 'thth') THEN 'refused'
            WHEN position = 3 THEN 'no such tool' END AS error
FROM calls""",
    "scored_dataset_files": """SELECT source AS dataset, 'rules' AS model, count(*) AS n,
       CAST(sum(n_chars % 5 + 1) AS DOUBLE) AS ratings, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents GROUP BY source""",
    "dataset_source": """SELECT lang, count(*) AS n,
       count(*) FILTER (doc_id % 4 <> 0) AS n_rated, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents GROUP BY lang""",
    "result_files": """SELECT source AS sheet, 'm.1' AS model, md5(text) AS content_md5,
       CAST(n_chars % 6 AS DOUBLE) AS rating, CAST(length(text) AS INTEGER) AS n_chars FROM documents""",
    "csv_documents": """SELECT doc_id, lang, md5(text) AS text_md5,
       CAST(length(text) AS INTEGER) AS n_chars FROM documents""",
    "label_sheet_source": """SELECT CAST(o_orderkey % 3 AS VARCHAR) AS sheet, o_orderkey AS position,
       o_orderpriority AS content, round(floor(o_totalprice / 50000) / 2, 6) AS rating FROM orders""",
    "page_source": f"""WITH {PAGE_TEXTS}
SELECT url, title, 'success' AS status, 'store' AS method,
       CAST(length(content) AS INTEGER) AS n_chars FROM texts""",
    "scored_labels_evaluated": """WITH pairs AS (
  SELECT source AS sheet, doc_id % 11 / 2 AS h, n_chars % 6 AS p FROM documents),
clean AS (SELECT sheet, round_even(h, 0) AS h, p FROM pairs WHERE h BETWEEN 1 AND 5 AND p BETWEEN 1 AND 5)
SELECT sheet, round(avg(abs(h - p)), 6) AS mae FROM clean GROUP BY sheet""",
    "label_sheets_merged": f"""WITH zipped AS (
  SELECT "human rating" AS human, rating FROM ({RATING_SQL["label_zip"]}))
SELECT count(*) AS n_raw,
       count(*) FILTER (human IS NOT NULL AND rating IS NOT NULL) AS n_rated,
       count(*) FILTER (human IS NULL OR rating IS NULL) AS n_dropped,
       count(*) FILTER (human BETWEEN 1 AND 5 AND rating BETWEEN 1 AND 5) AS n_valid
FROM zipped""",
}

ORACLE = {**RATING_SQL, **CHAT_SQL, **LINK_SQL, **SCORE_SQL, **STREAM_SQL}
