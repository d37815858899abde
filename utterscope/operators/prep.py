"""Input preparation and text cleaning operators.

All row-wise steps are single projections; the only shuffle is the dense
row index (B3), done as a distributed zip-with-index.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions import lexicon as lx
from utterscope.functions import text as tx


# ---------------------------------------------------------------- B1 ----
def canonicalise_columns(df: DataFrame, aliases: dict = lx.COLUMN_ALIASES) -> DataFrame:
    """Rename known aliases to canonical names; two present columns mapping
    to one name is an error (it would create duplicate columns)."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        if c in aliases:
            targets.setdefault(aliases[c], []).append(c)
    clash = {t: s for t, s in targets.items() if len(s) > 1}
    if clash:
        raise ValueError(f"several input columns map to the same name: {clash}")
    mapping = {s[0]: t for t, s in targets.items() if s[0] != t}
    return df.withColumnsRenamed(mapping) if mapping else df


# ---------------------------------------------------------------- B2 ----
def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"input must contain column(s) {missing}; found columns: {df.columns}")
    return df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """Inner join on ``keys`` in which a null key equals a null key."""
    other = right.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = reduce(and_, [left[k].eqNullSafe(other[f"_key{i}"]) for i, k in enumerate(keys)])
    return left.join(other, same).drop(*[f"_key{i}" for i in range(len(keys))])


# ---------------------------------------------------------------- B3 ----
def group_rank(df: DataFrame, by: list, order_cols: list, out: str = "_rank") -> DataFrame:
    """Exact 1-based rank of each row within its ``by`` group in
    ``order_cols`` order, with no single-task group: a range-partitioned
    sort spreads even a hot group over many partitions; rows are tagged with
    (partition, in-partition id); the per-(partition, group) counts — a
    table of partitions x groups rows — are prefix-summed and joined back.
    The tagged frame is checkpointed so every use sees one partitioning."""
    from utterscope.session import reliable_checkpoint, sized_broadcast
    by = list(by)
    tagged = reliable_checkpoint(
        df.orderBy(*by, *order_cols)
          .withColumn("_pid", F.spark_partition_id())
          .withColumn("_mid", F.monotonically_increasing_id()))
    keys = ["_pid"] + by
    counts = tagged.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    small = sized_broadcast(offsets.select(*keys, "_before", "_m0"), 1 << 20)
    return (null_safe_join(tagged, small, keys).withColumn(out, F.col("_before") + F.col("_mid") - F.col("_m0") + 1)
            .select(*df.columns, out))


def dense_index(df: DataFrame, order_cols: list, out: str = "_pos") -> DataFrame:
    """1-based dense position in ``order_cols`` order (distributed
    zip-with-index; no global single-partition window)."""
    return group_rank(df, [], order_cols, out)


def fill_missing_columns(df: DataFrame, order_cols: list) -> DataFrame:
    """``sim_{i}`` / ``timestamp_{i}`` (1-based position) when Interaction
    ID / Date/time are absent; empty Topic bot when absent."""
    need_pos = "Interaction ID" not in df.columns or "Date/time" not in df.columns
    out = dense_index(df, order_cols) if need_pos else df
    if "Interaction ID" not in df.columns:
        out = out.withColumn("Interaction ID", F.concat(F.lit("sim_"), F.col("_pos").cast("string")))
    if "Date/time" not in df.columns:
        out = out.withColumn("Date/time", F.concat(F.lit("timestamp_"), F.col("_pos").cast("string")))
    if "Topic bot" not in df.columns:
        out = out.withColumn("Topic bot", F.lit(""))
    return out.drop("_pos") if need_pos else out


# ---------------------------------------------------------------- B4 ----
def fill_null_values(df: DataFrame) -> DataFrame:
    return df.na.fill({"Interaction ID": "unknown", "Date/time": "unknown", "Topic bot": ""})


def prepare_utterances(df: DataFrame, order_cols: list) -> DataFrame:
    """B1 -> B2 -> B3 -> B4."""
    out = require_columns(canonicalise_columns(df), ["Phrase"])
    return fill_null_values(fill_missing_columns(out, order_cols))


# ---------------------------------------------------------------- B5 ----
def drop_incomplete(df: DataFrame, text: str, label: str) -> DataFrame:
    return df.na.drop(subset=[text, label]).withColumn(text, tx.unicode_strip(F.col(text).cast("string")))


# ---------------------------------------------------------- B6 / E30 ----
def validate_text(df: DataFrame, col: str, max_len: int = 512, out: str = "text_valid") -> DataFrame:
    return df.withColumn(out, tx.validate_text(col, max_len)) \
             .withColumn("truncated", tx.was_truncated(col, max_len))


def truncation_report(df: DataFrame, col: str, max_len: int = 512) -> DataFrame:
    return df.agg(F.count("*").alias("n"),
                  F.sum(tx.was_truncated(col, max_len).cast("int")).cast("long").alias("n_truncated"))


# ---------------------------------------------------------------- B9 ----
def gate_intent_context(label) -> "F.Column":
    lab = tx._c(label)
    return F.when(lab.isin(lx.LABEL_UNLISTED, lx.LABEL_NOMATCH), F.lit(None).cast("string")).otherwise(lab)


# --------------------------------------------------------------- B10 ----
# fixed values: the normaliser's prompt texts
BASE_SYSTEM_INSTRUCTION = (
    "Sei un assistente esperto in normalizzazione di testi per call center B2B (Lotto, POS, Servizi).\n"
    "Il tuo compito è trasformare il parlato rumoroso in una frase sintetica e formale.")
OBJECTIVE = (
    "**OBIETTIVO:**\n"
    "Estrai SOLO la richiesta tecnica o commerciale principale.\n"
    "Rimuovi esitazioni, ripetizioni e preamboli.\n"
    "MANTIENI: Codici errore, nomi prodotti, importi, verbi chiave.")
SPECIFIC_HEAD = "\n**INTENTO SPECIFICO:**\nL'utente sta parlando di: \""
SPECIFIC_TAIL = ("\nEstrai ESCLUSIVAMENTE i dettagli relativi a questo argomento. "
                 "Ignora altri discorsi non pertinenti.\n")
GENERIC_FOCUS = ("\n**FOCUS GENERALE:**\n"
                 "L'utente sta richiedendo assistenza su un servizio B2B. Identifica il problema principale.\n")


def system_prompt(intent, description, found) -> "F.Column":
    """Base instruction + objective + intent-specific focus (when the intent
    is non-empty and listed in the dimension) or the generic focus."""
    i, d = tx._c(intent), F.coalesce(tx._c(description), F.lit("None"))
    specific = F.concat(F.lit(SPECIFIC_HEAD), i, F.lit('" ('), d, F.lit(")."), F.lit(SPECIFIC_TAIL))
    focus = F.when(i.isNotNull() & (i != "") & tx._c(found), specific).otherwise(F.lit(GENERIC_FOCUS))
    return F.concat(F.lit(BASE_SYSTEM_INSTRUCTION + "\n" + OBJECTIVE + "\n"), focus)


def attach_intent_description(df: DataFrame, intent_col: str, dim: DataFrame,
                              max_dim_rows: int = 100000) -> DataFrame:
    """left join to the intent dimension (broadcast when its size is
    proven small, shuffle join otherwise)."""
    from utterscope.session import sized_broadcast
    d = dim.select(F.col("intent").alias("_dim_intent"), F.col("description").alias("intent_description"))
    out = df.join(sized_broadcast(d, max_dim_rows), F.col(intent_col) == F.col("_dim_intent"), "left")
    return out.withColumn("intent_found", F.col("_dim_intent").isNotNull()).drop("_dim_intent")


def build_chat_messages(df: DataFrame, raw: str, intent: str, dim: DataFrame,
                        examples: list[tuple[str, str]] | None = None) -> DataFrame:
    """ARRAY<STRUCT<role, content>> per row.  The cleaned text is used
    when longer than 3 characters, else the raw text."""
    out = attach_intent_description(df, intent, dim)
    clean = tx.strip_fillers(raw)
    final_input = F.when(F.length(clean) > 3, clean).otherwise(F.col(raw))
    msgs = [F.struct(F.lit("system").alias("role"),
                     system_prompt(F.col(intent), F.col("intent_description"),
                                   F.col("intent_found")).alias("content"))]
    for inp, outp in examples or []:
        msgs.append(F.struct(F.lit("user").alias("role"), F.lit(f"Input: {inp}").alias("content")))
        msgs.append(F.struct(F.lit("assistant").alias("role"), F.lit(outp).alias("content")))
    msgs.append(F.struct(F.lit("user").alias("role"),
                         F.concat(F.lit("Input: "), final_input).alias("content")))
    return out.withColumn("messages", F.array(*msgs))


# --------------------------------------------------------------- B12 ----
def echo_generator():
    """Default generator: returns the final user input (rule-based mode)."""
    def generate(messages: list) -> str:
        last = messages[-1]["content"] if len(messages) else ""
        return last[len("Input: "):] if last.startswith("Input: ") else last
    return generate


def needs_generation(text, cleaned, min_words: int = 3) -> "F.Column":
    """Whether the generator is asked for a row: its text is not empty and
    its cleaned text has ``min_words`` words or more."""
    t, c = tx._c(text), tx._c(cleaned)
    return F.coalesce(t != "", F.lit(False)) & (c != "") & (tx.word_count(c) >= min_words)


def normalise_phrases(df: DataFrame, text: str, intent: str, dim: DataFrame,
                      examples: list[tuple[str, str]] | None = None, make_generator=None,
                      out: str = "normalised") -> DataFrame:
    """B7 -> B8 -> B10 -> B12 -> B11: rows without enough words take the
    rule-based result; only the others are prompted and reach the generator."""
    marked = tx.computed_once(df, "_clean", tx.strip_fillers(text))
    asks = needs_generation(text, "_clean")
    ruled = marked.where(~asks).withColumn(out, tx.normalise_from_clean(text, "_clean"))
    asked = build_chat_messages(marked.where(asks), text, intent, dim, examples)
    asked = generate_text(asked.select(*marked.columns, "messages"), "messages", "_clean", make_generator or echo_generator, out)
    return ruled.select(*df.columns, out).union(asked.select(*df.columns, out))


GENERATED_AT_ONCE = 256  # rows whose messages are Python objects at a time


def generate_text(df: DataFrame, messages: str = "messages", fallback: str = "fallback",
                  make_generator=echo_generator, out: str = "generated") -> DataFrame:
    """Per-row generation over chat messages with a user-supplied
    generator loaded once per partition (``mapInArrow``), then the B11
    guard.  Failures fall back to the cleaned text.  Only the messages and
    fallbacks become Python objects, ``GENERATED_AT_ONCE`` rows at a time."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(df.schema.fields + [StructField(out, StringType())])
    at_m, at_f = df.columns.index(messages), df.columns.index(fallback)

    def run(batches):
        gen = make_generator()
        for whole in batches:
            for at in range(0, whole.num_rows, GENERATED_AT_ONCE):
                b = whole.slice(at, GENERATED_AT_ONCE)
                vals = []
                for m, fb in zip(b.column(at_m).to_pylist(), b.column(at_f).to_pylist()):
                    try:
                        vals.append(gen([dict(x) for x in m]))
                    except Exception:  # noqa: BLE001 — generation errors fall back
                        vals.append(fb)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vals, type=pa.string())], names=[*b.schema.names, out])
    g = df.mapInArrow(run, schema)
    return g.withColumn(out, tx.guard_generated(out, fallback))


# --------------------------------------------------------- B14 / E30 ----
def filter_min_words(df: DataFrame, cleaned: str, min_words: int = 3) -> DataFrame:
    return df.where(tx.word_count(cleaned) >= min_words)


def kept_ratio(df: DataFrame, cleaned: str, min_words: int = 3) -> DataFrame:
    kept = F.sum((tx.word_count(cleaned) >= min_words).cast("int"))
    return df.agg(F.count("*").alias("n"), kept.cast("long").alias("kept"),
                  F.round(F.try_divide(100.0 * kept, F.count("*")), 6).alias("kept_pct"))


# --------------------------------------------------------------- B15 ----
def filter_unlisted(df: DataFrame, text_in: str, text_out: str = "text") -> DataFrame:
    """Keep UNLISTED rows when the report has a ``Topic tool`` column (else
    keep all) and copy the text column to the standard name."""
    tool = "Topic tool" if "Topic tool" in df.columns else None
    out = df.where(F.col(tool) == lx.LABEL_UNLISTED) if tool else df
    if text_in in df.columns and text_in != text_out:
        out = out.withColumn(text_out, F.col(text_in))
    require_columns(out, [text_out])
    return out


# --------------------------------------------------------------- B20 ----
def pick_text_column(df: DataFrame, preferred: str = "UserUtterance") -> str:
    return preferred if preferred in df.columns else df.columns[0]


# ---------------------------------------------------------------- F4 ----
def restore_original_rows(original: DataFrame, results: DataFrame, key) -> DataFrame:
    """Results put back on the surviving original rows (inner join on key)."""
    return original.join(results, key, "inner")


def dropped_rows(original: DataFrame, results: DataFrame, key) -> DataFrame:
    return original.join(results, key, "left_anti")
