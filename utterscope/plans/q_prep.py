"""Preparation, cleaning and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterscope.functions import text as tx
from utterscope.operators import prep as pp
from utterscope.plans import sql as q
from utterscope.plans import tables as tb
from utterscope.plans.registry import query
from utterscope.sources import readers as rd
from utterscope.sources import writers as wr

# Intent dimension used with conversations (role as intent): two of the
# three roles are described, so the generic-focus branch also occurs.
INTENT_DIM = [("user", "richiesta del cliente", 80), ("assistant", "risposta del servizio", 20)]
EXAMPLES = [("allora volevo sapere il saldo", "saldo conto"),
            ("buongiorno il pos non stampa", "pos non stampa")]


def intent_dim(spark):
    return spark.createDataFrame(INTENT_DIM, rd.INTENT_DIM_SCHEMA)


def _dim_sql() -> str:
    rows = ", ".join(f"('{i}', '{d}', {p})" for i, d, p in INTENT_DIM)
    return f"dim(intent, description, priority) AS (VALUES {rows})"


def _conv_input(spark, sf):
    """Conversations as an utterance input with aliased column names."""
    return tb.utterances(spark, sf).withColumnRenamed("role", "Bot Topic")


UTTER_SQL = """SELECT conv_id, turn, 'sim_' || CAST(row_number() OVER (ORDER BY conv_id, turn) AS VARCHAR) AS "Interaction ID",
       'timestamp_' || CAST(row_number() OVER (ORDER BY conv_id, turn) AS VARCHAR) AS "Date/time",
       text AS "Phrase", coalesce(role, '') AS "Topic bot" FROM conversations"""


@query("utterance_input", UTTER_SQL)
def utterance_input(spark, sf):
    """B1 + B2 + B3 + B4: aliases, required column, positional fillers, nulls."""
    u = pp.prepare_utterances(_conv_input(spark, sf), ["conv_id", "turn"])
    return u.select("conv_id", "turn", "Interaction ID", "Date/time", "Phrase", "Topic bot")


@query("read_utterances_csv", UTTER_SQL)
def read_utterances_csv(spark, sf):
    """A6 -> A1 round trip: write the input as a semicolon CSV to the shared
    scratch folder, read it back with delimiter detection, then B1–B4."""
    from utterscope.session import scratch_table_path
    path = scratch_table_path(spark, "utterances-csv")
    src = _conv_input(spark, sf).withColumnRenamed("text", "Testo")
    (src.write.mode("overwrite").option("header", True).option("sep", ";").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = rd.read_utterances(spark, path)
    back = back.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "Bot Topic", "Testo")
    u = pp.prepare_utterances(back, ["conv_id", "turn"])
    return u.select("conv_id", "turn", "Interaction ID", "Date/time", "Phrase", "Topic bot")


@query("validated_text", f"""SELECT doc_id, substring({q.ustrip("coalesce(text, '')")}, 1, 512) AS text_valid,
  length({q.ustrip("coalesce(text, '')")}) > 512 AS truncated FROM documents""")
def validated_text(spark, sf):
    """Null -> '', strip, first 512 characters (+ truncated flag)."""
    d = tb.table(spark, sf, "documents")
    return pp.validate_text(d, "text", 512).select("doc_id", "text_valid", "truncated")


@query("truncation_report", f"""SELECT count(*) AS n,
  CAST(sum(CASE WHEN length({q.ustrip("coalesce(text, '')")}) > 512 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated
FROM documents""")
def truncation_report(spark, sf):
    """E30 (truncated count as an aggregate, not an accumulator)."""
    return pp.truncation_report(tb.table(spark, sf, "documents"), "text", 512)


@query("text_preview", """SELECT doc_id, substring(text, 1, 80) AS preview_80, substring(text, 1, 50) AS preview_50
FROM documents""")
def text_preview(spark, sf):
    """B19."""
    d = tb.table(spark, sf, "documents")
    return d.select("doc_id", tx.text_preview("text", 80).alias("preview_80"),
                    tx.text_preview("text", 50).alias("preview_50"))


@query("drop_incomplete", f"""SELECT d.doc_id, {q.ustrip("CAST(d.text AS VARCHAR)")} AS text, CAST(l.quality AS VARCHAR) AS intent
FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def drop_incomplete(spark, sf):
    """A2 + B5: labelled rows (written as a labelled-utterance parquet and
    read back through the reader), nulls dropped, text stripped."""
    from utterscope.session import scratch_table_path
    path = scratch_table_path(spark, "labelled")
    tb.labelled_documents(spark, sf).select(
        "doc_id", "text", F.col("quality").cast("string").alias("intent")).write.mode("overwrite").parquet(path)
    ld = rd.read_labelled(spark, path, "text", "intent", keep=["doc_id"])
    return pp.drop_incomplete(ld, "text", "intent")


RULE_SQL = f"""WITH c AS (SELECT doc_id, text, {q.strip_fillers_sql('text')} AS cleaned FROM documents)
SELECT doc_id, cleaned,
  CASE WHEN text IS NULL OR text = '' THEN ''
       WHEN cleaned = '' OR len({q.tokens_sql('cleaned')}) < 3 THEN text ELSE cleaned END AS normalised
FROM c"""


@query("rule_normalised", RULE_SQL)
def rule_normalised(spark, sf):
    """B7 + B8 on whole documents."""
    d = tb.spread(tb.table(spark, sf, "documents").select("doc_id", "text"))
    d = tx.computed_once(d, "cleaned", tx.strip_fillers("text"))
    return d.select("doc_id", "cleaned", tx.normalise_from_clean("text", "cleaned").alias("normalised"))


DISC_SQL = f"""SELECT doc_id, lang, {q.discovery_clean_sql('text')} AS cleaned FROM documents"""


@query("discovery_clean", f"""WITH c AS ({DISC_SQL})
SELECT doc_id, cleaned, CAST(len({q.tokens_sql('cleaned')}) AS INTEGER) AS n_words FROM c""")
def discovery_clean(spark, sf):
    """B13 on whole documents."""
    d = tb.cleaned_documents(spark, sf)
    return d.select("doc_id", "cleaned", tx.word_count("cleaned").alias("n_words"))


@query("filter_min_words", f"""WITH c AS ({DISC_SQL})
SELECT doc_id, cleaned FROM c WHERE len({q.tokens_sql('cleaned')}) >= 3""")
def filter_min_words(spark, sf):
    """Rows with at least 3 cleaned words, original key kept."""
    d = tb.cleaned_documents(spark, sf)
    return pp.filter_min_words(d, "cleaned", 3).select("doc_id", "cleaned")


@query("kept_ratio", f"""WITH c AS ({DISC_SQL})
SELECT count(*) AS n, CAST(sum(CASE WHEN len({q.tokens_sql('cleaned')}) >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
  round(100.0 * sum(CASE WHEN len({q.tokens_sql('cleaned')}) >= 3 THEN 1 ELSE 0 END) / count(*), 6) AS kept_pct FROM c""")
def kept_ratio(spark, sf):
    """Share of rows kept by the discovery cleaner."""
    d = tb.cleaned_documents(spark, sf)
    return pp.kept_ratio(d, "cleaned", 3)


@query("restore_original_rows", f"""WITH c AS ({DISC_SQL}),
kept AS (SELECT doc_id, cleaned FROM c WHERE len({q.tokens_sql('cleaned')}) >= 3)
SELECT d.doc_id, d.lang, d.source, k.cleaned FROM documents d JOIN kept k USING (doc_id)""")
def restore_original_rows(spark, sf):
    """cleaned results put back on the surviving original rows."""
    d = tb.table(spark, sf, "documents")
    res = pp.filter_min_words(tb.cleaned_documents(spark, sf), "cleaned", 3)
    return pp.restore_original_rows(d.select("doc_id", "lang", "source"), res, "doc_id")


@query("dropped_rows", f"""WITH c AS ({DISC_SQL})
SELECT doc_id, lang FROM c WHERE len({q.tokens_sql('cleaned')}) < 3""")
def dropped_rows(spark, sf):
    """F4 complement: rows the cleaner dropped (left anti join)."""
    d = tb.table(spark, sf, "documents")
    res = pp.filter_min_words(tb.cleaned_documents(spark, sf), "cleaned", 3)
    return pp.dropped_rows(d.select("doc_id", "lang"), res.select("doc_id"), "doc_id")


def _prompt_sql(intent: str, found: str, desc: str) -> str:
    base = (pp.BASE_SYSTEM_INSTRUCTION + "\n" + pp.OBJECTIVE + "\n").replace("'", "''")
    head = pp.SPECIFIC_HEAD.replace("'", "''")
    tail = pp.SPECIFIC_TAIL.replace("'", "''")
    generic = pp.GENERIC_FOCUS.replace("'", "''")
    return (f"'{base}' || CASE WHEN {intent} IS NOT NULL AND {intent} <> '' AND {found} "
            f"THEN '{head}' || {intent} || '\" (' || coalesce({desc}, 'None') || ').' || '{tail}' "
            f"ELSE '{generic}' END")


CHAT_SQL = f"""WITH {_dim_sql()},
c AS (SELECT conv_id, turn, role, text, {q.strip_fillers_sql('text')} AS clean FROM conversations),
j AS (SELECT c.*, d.description, d.intent IS NOT NULL AS found FROM c LEFT JOIN dim d ON c.role = d.intent)"""


@query("chat_messages", f"""{CHAT_SQL}
SELECT conv_id, turn, CAST({2 + 2 * len(EXAMPLES)} AS INTEGER) AS n_messages,
  {_prompt_sql('role', 'found', 'description')} AS system_content,
  'Input: ' || CASE WHEN length(clean) > 3 THEN clean ELSE text END AS user_content FROM j""")
def chat_messages(spark, sf):
    """B10 + F2: system prompt with intent description, few-shot pairs, input."""
    import json
    from utterscope.session import scratch_table_path
    path = scratch_table_path(spark, "examples-json")
    doc = json.dumps([{"input": i, "output": o} for i, o in EXAMPLES])
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    examples = rd.read_examples(spark, path)          # A4: few-shot examples file
    u = tb.utterances(spark, sf)
    m = pp.build_chat_messages(u, "text", "role", intent_dim(spark), examples)
    return m.select("conv_id", "turn", F.size("messages").alias("n_messages"),
                    F.element_at("messages", 1)["content"].alias("system_content"),
                    F.element_at("messages", -1)["content"].alias("user_content"))


@query("generated_text", f"""{CHAT_SQL},
g AS (SELECT *, CASE WHEN length(clean) > 3 THEN clean ELSE text END AS gen FROM j)
SELECT conv_id, turn,
  CASE WHEN text IS NULL OR text = '' THEN ''
       WHEN clean = '' OR len({q.tokens_sql('clean')}) < 3 THEN text
       WHEN length(clean) > 5 AND length(gen) > length(clean) * 1.5 THEN clean ELSE gen END AS normalised
FROM g""")
def generated_text(spark, sf):
    """B12 (+B8, B11): rule-based gate, then per-partition generation with the
    default generator, then the length guard."""
    out = pp.normalise_phrases(tb.utterances(spark, sf), "text", "role", intent_dim(spark), EXAMPLES)
    return out.select("conv_id", "turn", "normalised")


@query("guard_generated", f"""WITH c AS (SELECT conv_id, turn, text, {q.strip_fillers_sql('text')} AS fb FROM conversations),
n AS (SELECT a.conv_id, a.turn, a.fb, b.text AS cand FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN cand IS NULL OR (length(fb) > 5 AND length(cand) > length(fb) * 1.5) THEN fb
                           ELSE cand END AS guarded FROM n""")
def guard_generated(spark, sf):
    """The next turn plays the generated text; keyed self-join on
    (conv_id, turn + 1) (no per-conversation window)."""
    u = tb.utterances(spark, sf).select("conv_id", "turn", "text")
    a = u.withColumn("fb", tx.strip_fillers("text"))
    b = u.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand"))
    j = a.join(b, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", tx.guard_generated("cand", "fb").alias("guarded"))


@query("intent_context_gate", f"""WITH {q.classified_cte()}
SELECT vec_id, tool_label, CASE WHEN tool_label IN ('UNLISTED', 'NOMATCH') THEN NULL ELSE tool_label END AS intent_context
FROM classified""")
def intent_context_gate(spark, sf):
    """B9."""
    c = tb.classified(spark, sf)
    return c.select("vec_id", "tool_label", pp.gate_intent_context("tool_label").alias("intent_context"))


@query("filter_unlisted", f"""WITH {q.classified_cte()}
SELECT CAST(d.doc_id AS VARCHAR) AS "Interaction ID", d.text FROM documents d
JOIN classified c ON c.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) WHERE c.tool_label = 'UNLISTED'""")
def filter_unlisted(spark, sf):
    """B15 over the prediction report (``Topic tool`` present): every document
    with the decision on its vector."""
    n = tb.table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    c = tb.classified(spark, sf).select("vec_id", F.col("tool_label").alias("Topic tool"))
    d = tb.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("Interaction ID"),
                                                F.pmod("doc_id", n).alias("vec_id"), F.col("text").alias("Phrase"))
    return pp.filter_unlisted(d.join(c, "vec_id"), "Phrase", "text").select("Interaction ID", "text")


@query("pick_text_column", """SELECT conv_id, turn, text AS "User_Sentence" FROM conversations""")
def pick_text_column(spark, sf):
    """``UserUtterance`` when present, else the first column."""
    u = tb.utterances(spark, sf).withColumnRenamed("text", "UserUtterance")
    col = pp.pick_text_column(u)
    return u.select("conv_id", "turn", F.col(col).cast("string").alias("User_Sentence"))


@query("intent_dim_join", f"""WITH {_dim_sql()}
SELECT c.conv_id, c.turn, c.role, d.description AS intent_description, d.intent IS NOT NULL AS intent_found
FROM conversations c LEFT JOIN dim d ON c.role = d.intent""")
def intent_dim_join(spark, sf):
    """F2 / A3: intent dimension read from JSON and joined (size-checked broadcast)."""
    from utterscope.session import scratch_table_path
    path = scratch_table_path(spark, "intent-dim-json")
    import json
    doc = json.dumps([{"intent": i, "description": d, "priority": p} for i, d, p in INTENT_DIM])
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    dim = rd.read_intent_dim(spark, path)
    out = pp.attach_intent_description(tb.utterances(spark, sf), "role", dim)
    return out.select("conv_id", "turn", "role", "intent_description", "intent_found")


@query("write_report_roundtrip", f"""WITH {q.report_cte()}
SELECT CAST(vec_id AS VARCHAR) AS vec_id, tool_label, status, summary FROM report""")
def write_report_roundtrip(spark, sf):
    """A5 + A6: the prediction report written as CSV and read back."""
    from utterscope.plans.q_scoring import report
    from utterscope.session import scratch_table_path
    path = scratch_table_path(spark, "report-csv")
    rep = report(spark, sf).select("vec_id", "tool_label", "status", "summary")
    wr.write_report(rep, path, "csv")
    return rd.read_predictions(spark, path, fmt="csv").select("vec_id", "tool_label", "status", "summary")


PREDICT_SQL = f"""WITH {q.report_cte()},
u AS (SELECT doc_id, text AS phrase, substring({q.ustrip("coalesce(text, '')")}, 1, 512) AS txt,
             row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
c AS (SELECT *, {q.strip_fillers_sql('txt')} AS clean FROM u),
g AS (SELECT *, CASE WHEN length(clean) > 3 THEN clean ELSE txt END AS gen FROM c)
SELECT CAST(g.doc_id AS VARCHAR) AS "Interaction ID", 'timestamp_' || g.pos AS "Date/time", g.phrase AS "Phrase",
  r.bot_topic AS "Topic bot",
  CASE WHEN txt = '' THEN '' WHEN clean = '' OR len({q.tokens_sql('clean')}) < 3 THEN txt
       WHEN length(clean) > 5 AND length(gen) > length(clean) * 1.5 THEN clean ELSE gen END AS "Phrase normalized",
  r.tool_label AS "Topic tool", r.summary AS "Summary", round_even(r.confidence * 10, 2) AS "Confidence"
FROM g JOIN report r ON r.vec_id = g.doc_id % (SELECT count(*) FROM embeddings)"""


@query("predict_job", PREDICT_SQL)
def predict_job(spark, sf):
    """I7 + F5: every document as an utterance, scored through the vector of
    its id, to the eight columns of the report."""
    from utterscope.config import InferenceSettings
    from utterscope.operators import jobs
    n = tb.table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    vectors = tb.scored(spark, sf).select("vec_id", "logits", "class_names", tb.bot_topic().alias("Bot Topic"))
    d = tb.table(spark, sf, "documents").select(F.pmod("doc_id", n).alias("vec_id"), F.col("doc_id").cast("string").alias("ID"),
                                                F.col("text").alias("Testo"), "doc_id")
    settings = InferenceSettings(temperature=tb.TEMPERATURE, confidence_threshold=tb.THRESHOLD)
    return jobs.predict_report(d.join(vectors, "vec_id"), lambda rows: rows, settings, ["doc_id"], intent_dim(spark), EXAMPLES)
