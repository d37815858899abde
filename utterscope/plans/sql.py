"""Shared SQL fragments for the DuckDB oracles (written independently of the
Spark code paths: long-form aggregation, joins and window functions)."""

from __future__ import annotations


def intent_name_sql(col: str) -> str:
    return f"CASE WHEN {col} = 0 THEN 'NOMATCH' ELSE 'intent_' || CAST({col} AS VARCHAR) END"


def centroids_cte(source: str = "embeddings", key: str = "label", name: str = "cent") -> str:
    """CTE ``{name}(key, c DOUBLE[], n)`` — plain mean vector per key."""
    return f"""
{name}_long AS (
  SELECT {key}, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS x
  FROM (SELECT {key}, CAST(embedding AS DOUBLE[]) AS v FROM {source}) s),
{name} AS (
  SELECT {key}, list(m ORDER BY pos) AS c, max(n) AS n FROM (
    SELECT {key}, pos, avg(x) AS m, count(x) AS n FROM {name}_long GROUP BY {key}, pos) t
  GROUP BY {key})"""


def scored_cte(metric: str = "cosine", scale: float = 20.0, sfx: str = "") -> str:
    """CTEs ending in ``scored{sfx}(vec_id, label, true_label, v, logits, class_names)``."""
    if metric == "cosine":
        sim = (f"{scale} * list_dot_product(e.v, k.c) / "
               "(sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * k.cnorm)")
    else:
        sim = (f"-{scale} * sqrt(list_sum(list_transform(list_zip(e.v, k.c), "
               "lambda p: (p[1] - p[2]) * (p[1] - p[2]))))")
    return f"""
emb{sfx} AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{centroids_cte(name='cent' + sfx)},
cls{sfx} AS (
  SELECT label AS cls, {intent_name_sql('label')} AS name, c,
         sqrt(list_sum(list_transform(c, lambda x: x * x))) AS cnorm FROM cent{sfx}),
lg{sfx} AS (
  SELECT e.vec_id, list({sim} ORDER BY k.cls) AS logits, list(k.name ORDER BY k.cls) AS class_names
  FROM emb{sfx} e CROSS JOIN cls{sfx} k GROUP BY e.vec_id),
scored{sfx} AS (
  SELECT e.vec_id, e.label, {intent_name_sql('e.label')} AS true_label, e.v, l.logits, l.class_names
  FROM emb{sfx} e JOIN lg{sfx} l USING (vec_id))"""


def softmax_sql(logits: str, temperature) -> str:
    z = f"list_transform({logits}, lambda x: x / {temperature})"
    e = f"list_transform({z}, lambda x: exp(x - list_max({z})))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


def classified_cte(temperature: float = 1.2, threshold: float = 0.65, metric: str = "cosine") -> str:
    """CTEs ending in ``classified`` (+ probs, confidence, pred_idx,
    pred_label, tool_label, status)."""
    return f"""{scored_cte(metric)},
probs AS (SELECT *, {softmax_sql('logits', temperature)} AS probs FROM scored),
argm AS (SELECT *, list_max(probs) AS confidence,
                CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred_idx,
                class_names[list_position(probs, list_max(probs))] AS pred_label FROM probs),
classified AS (
  SELECT *,
    CASE WHEN pred_label = 'NOMATCH' THEN 'NOMATCH'
         WHEN confidence < {threshold} THEN 'UNLISTED' ELSE pred_label END AS tool_label,
    CASE WHEN pred_label = 'NOMATCH' THEN 'NO_MATCH'
         WHEN confidence < {threshold} THEN 'UNLISTED' ELSE 'VALID' END AS status
  FROM argm)"""


def bot_topic_sql() -> str:
    return f"CASE WHEN vec_id % 5 = 0 THEN '' ELSE {intent_name_sql('label')} END"


def summary_sql(status: str, bot: str, tool: str) -> str:
    b = f"trim(coalesce({bot}, ''))"
    return (f"CASE WHEN {status} <> 'VALID' THEN {status} WHEN {b} = '' THEN 'MATCH' "
            f"WHEN {b} = {tool} THEN 'MATCH_BOT' ELSE 'MISMATCH' END")


def report_cte(temperature: float = 1.2, threshold: float = 0.65) -> str:
    """... ending in ``report(vec_id, label, true_label, bot_topic, tool_label,
    status, confidence, pred_idx, probs, summary)``."""
    return f"""{classified_cte(temperature, threshold)},
report AS (
  SELECT vec_id, label, true_label, {bot_topic_sql()} AS bot_topic, tool_label, status,
         confidence, pred_idx, pred_label, probs, logits, class_names,
         {summary_sql('status', bot_topic_sql(), 'tool_label')} AS summary
  FROM classified)"""


# ------------------------------------------------------------ text ----
# Java's Unicode whitespace (what Spark's (?U)\s matches); DuckDB's \s is ASCII.
WS_CHARS = (r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CHARS}]"
WORD = r"\pL\pN\pM_"


def ustrip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(expr: str) -> str:
    return ustrip(f"regexp_replace({expr}, '{WS}+', ' ', 'g')")


def word_sub(expr: str, alternation: str, repl: str = "") -> str:
    """Whole-word replacement with Unicode word boundaries (applied twice so
    that adjacent matches sharing one separator are all replaced)."""
    alt = alternation.replace(r"\s", WS).replace("'", "''")
    pat = f"(^|[^{WORD}])({alt})([^{WORD}]|$)"
    one = f"regexp_replace({expr}, '{pat}', '\\1{repl}\\3', 'g')"
    return f"regexp_replace({one}, '{pat}', '\\1{repl}\\3', 'g')"


def tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda w: w <> '')"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def strip_fillers_sql(expr: str) -> str:
    from utterscope.functions import lexicon as lx
    out = f"lower({expr})"
    for words in (lx.GREETINGS, lx.FILLERS, lx.META_TALK):
        out = word_sub(out, "|".join(words))
    return collapse(out)


def discovery_clean_sql(expr: str) -> str:
    from utterscope.functions import lexicon as lx
    out = f"lower(coalesce({expr}, ''))"
    for pattern, repl in lx.DOMAIN_REWRITES:
        out = word_sub(out, pattern, repl)
    out = f"regexp_replace({out}, '[^{lx.KEPT_CHARS}{WS_CHARS}]', ' ', 'g')"
    drop = sql_list(dict.fromkeys(lx.STOPWORDS + lx.VOICE_FILLERS))
    toks = (f"list_filter({tokens_sql(out)}, lambda w: NOT list_contains({drop}, w) "
            "AND length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+'))")
    return f"array_to_string({toks}, ' ')"
