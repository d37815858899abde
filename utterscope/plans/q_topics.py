"""Topic keyword / label / report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterscope.functions import lexicon as lx
from utterscope.functions import text as tx
from utterscope.operators import geometry as ge
from utterscope.operators import topics as tp
from utterscope.plans import sql as q
from utterscope.plans import tables as tb
from utterscope.plans.q_geometry import T_SQL, dist_sql
from utterscope.plans.registry import query

R6 = 6
STOP = q.sql_list(lx.STOPWORDS)


def _kw_sql(src: str, topic: str, top_n: int) -> str:
    """CTEs over ``src(topic, cleaned)`` ending in ``kw(topic, rank, term, score)``."""
    return f"""tok AS (SELECT {topic} AS topic, list_filter(string_split(cleaned, ' '),
                  lambda w: w <> '' AND length(w) >= 2 AND NOT list_contains({STOP}, w)) AS t FROM {src}),
ng AS (SELECT topic, unnest(t) AS term FROM tok
       UNION ALL SELECT topic, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
       FROM tok WHERE len(t) >= 2),
cnt AS (SELECT topic, term, count(*) AS tf FROM ng GROUP BY topic, term),
keep AS (SELECT term FROM cnt GROUP BY term HAVING count(DISTINCT topic) >= 2
         AND count(DISTINCT topic) <= CAST(0.95 AS DOUBLE) * (SELECT count(DISTINCT topic) FROM cnt)),
kc AS (SELECT * FROM cnt WHERE term IN (SELECT term FROM keep)),
pt AS (SELECT topic, sum(tf) AS tot FROM kc GROUP BY topic),
pw AS (SELECT term, sum(tf) AS f FROM kc GROUP BY term),
aa AS (SELECT floor(avg(tot)) AS a FROM pt),
sc AS (SELECT kc.topic, kc.term, kc.tf / pt.tot * ln(1 + aa.a / pw.f) AS score
       FROM kc JOIN pt USING (topic) JOIN pw USING (term), aa),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM sc) z
       WHERE rank <= {top_n})"""


DOCS_SQL = f"""docs AS (SELECT doc_id, lang, {q.discovery_clean_sql('text')} AS cleaned FROM documents)"""
TR_SQL = f"""{T_SQL},
tr AS (SELECT d.doc_id, t.topic_id, t.v, d.text, {q.discovery_clean_sql('d.text')} AS cleaned
       FROM t JOIN documents d ON t.vec_id = d.doc_id % (SELECT count(*) FROM embeddings))"""


def _docs(spark, sf):
    return tb.cleaned_documents(spark, sf, "lang")


@query("ngram_counts", f"""WITH {DOCS_SQL}, {_kw_sql('docs', 'lang', 10)}
SELECT topic AS lang, term, tf FROM cnt""")
def ngram_counts(spark, sf):
    """H1: unigram + bigram counts per topic (lang) over cleaned documents."""
    c = tp.ngram_counts(_docs(spark, sf), "cleaned", "lang", pre_cleaned=True)
    return c.select("lang", "term", "tf")


@query("topic_keywords", f"""WITH {DOCS_SQL}, {_kw_sql('docs', 'lang', 10)}
SELECT topic AS lang, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM kw""")
def topic_keywords(spark, sf):
    """H2 + H3: document-frequency pruning and top-10 c-TF-IDF terms."""
    k = tp.topic_keywords(_docs(spark, sf), "cleaned", "lang", 10, pre_cleaned=True)
    return k.select("lang", "rank", "term", F.round("score", R6).alias("score"))


@query("mmr_keywords")
def mmr_keywords(spark, sf):
    """H4: MMR re-ranking (diversity 0.4) of 30 candidates per topic."""
    k = tp.topic_keywords(_docs(spark, sf), "cleaned", "lang", 30, pre_cleaned=True)
    return tp.mmr_keywords(k, "lang", 10, 0.4)


INFO_SQL = f"""{TR_SQL}, {_kw_sql('tr', 'topic_id', 10)},
kl AS (SELECT topic, list(term ORDER BY rank) AS kws FROM kw GROUP BY topic),
sizes AS (SELECT topic_id AS topic, count(*) AS n FROM tr GROUP BY topic_id),
info AS (SELECT s.topic, s.n, coalesce(kl.kws, []) AS kws,
                CAST(s.topic AS VARCHAR) || CASE WHEN len(coalesce(kl.kws, [])) > 0
                  THEN '_' || array_to_string(kl.kws[1:4], '_') ELSE '' END AS name
         FROM sizes s LEFT JOIN kl USING (topic))"""


def _info(spark, sf):
    # cleaned once: keywords and sizes read it
    from utterscope.session import written_table
    rows = written_table(tb.topic_rows(spark, sf).select("topic_id", "cleaned"), "topic_rows")
    return tp.topic_info(rows, "cleaned", "topic_id", 10, pre_cleaned=True)


@query("topic_info", f"""WITH {INFO_SQL}
SELECT topic AS topic_id, n AS count, name, array_to_string(kws, ',') AS keywords FROM info""")
def topic_info(spark, sf):
    """H5: topic, count, name and keywords (noise counts as a topic)."""
    i = _info(spark, sf)
    return i.select("topic_id", "count", "name", F.array_join("keywords", ",").alias("keywords"))


def _label_report_sql(tid: str, name: str) -> str:
    c = f"regexp_replace(regexp_replace({name}, '^[0-9]+\\s*[_-]\\s*', ''), '[_''\"]+', ' ', 'g')"
    return f"CASE WHEN {tid} = -1 THEN 'NOISE' WHEN {name} IS NULL THEN 'Topic ' || {tid} ELSE {q.collapse(c)} END"


def _label_output_sql(tid: str, name: str) -> str:
    c = q.ustrip(f"replace(replace(replace({name}, '_', ' '), '\"', ''), '''', '')")
    c = f"regexp_replace(regexp_replace({c}, '^[0-9]+\\s*', ''), '{q.WS}+', ' ', 'g')"
    return f"CASE WHEN {tid} = -1 THEN 'NOISE' ELSE {c} END"


@query("topic_labels", f"""WITH {INFO_SQL},
lab AS (SELECT topic, {_label_report_sql('topic', 'name')} AS label_report,
               {_label_output_sql('topic', 'name')} AS label_output FROM info)
SELECT tr.doc_id, tr.topic_id, lab.label_report, lab.label_output FROM tr LEFT JOIN lab ON lab.topic = tr.topic_id""")
def topic_labels(spark, sf):
    """B16 + B17 + F3: both label cleaners, attached to every row."""
    i = _info(spark, sf).select("topic_id", tx.topic_label_report("topic_id", "name").alias("label_report"),
                                tx.topic_label_output("topic_id", "name").alias("label_output"))
    rows = tb.topic_of_documents(spark, sf).select("doc_id", "topic_id")
    return tp.attach_topic_label(rows, i, "topic_id").select("doc_id", "topic_id", "label_report", "label_output")


MEMB_SQL = f"""{TR_SQL},
lg AS (SELECT tr.doc_id, list(-1.0 * {dist_sql('tr.v', 'c.c')} ORDER BY c.topic_id) AS logits,
              list(c.topic_id ORDER BY c.topic_id) AS ids FROM tr, cent c GROUP BY tr.doc_id),
pm AS (SELECT doc_id, ids, list_transform(list_transform(logits, lambda x: exp(x - list_max(logits))),
        lambda y: y / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS probs FROM lg),
rowp AS (SELECT tr.*, CASE WHEN tr.topic_id = -1 THEN 0.0
                          ELSE pm.probs[list_position(pm.ids, tr.topic_id)] END AS p
         FROM tr JOIN pm USING (doc_id)),
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id
         ORDER BY p DESC, length(cleaned) DESC, doc_id DESC) AS rep_rank FROM rowp) z WHERE rep_rank <= 5)"""


def _with_prob(spark, sf):
    """Topic rows with the row's own-topic membership probability (0 for noise)."""
    t = tb.topic_rows(spark, sf)
    m = ge.own_probability(t, "doc_id", "topic_id", "v")
    # materialised once: keywords, sizes and representatives all read it
    from utterscope.session import reliable_checkpoint
    return reliable_checkpoint(t.join(m, "doc_id"))


@query("representative_rows", f"""WITH {MEMB_SQL}
SELECT topic_id, CAST(rep_rank AS INTEGER) AS rep_rank, doc_id, round(p, 6) AS prob, substring(cleaned, 1, 80) AS preview
FROM reps""")
def representative_rows(spark, sf):
    """G1: top 5 rows per topic (probability, cleaned length, later row)."""
    r = tp.representative_rows(_with_prob(spark, sf), "topic_id", "doc_id", "p", "cleaned", 5)
    return r.select("topic_id", "rep_rank", "doc_id", F.round("p", R6).alias("prob"),
                    F.substring("cleaned", 1, 80).alias("preview"))


def _prompt_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("topic_prompt", f"""WITH {MEMB_SQL}, {_kw_sql('tr', 'topic_id', 10)},
kl AS (SELECT topic AS topic_id, list(term ORDER BY rank) AS kws FROM kw GROUP BY topic),
dl AS (SELECT topic_id, string_agg('- ' || substring(cleaned, 1, 100) || chr(10), '' ORDER BY rep_rank) AS docs
       FROM reps GROUP BY topic_id)
SELECT topic_id, {_prompt_lit(tp.TOPIC_PROMPT_HEAD)} || docs || {_prompt_lit(tp.TOPIC_PROMPT_MID)}
       || array_to_string(kws, ', ') || {_prompt_lit(tp.TOPIC_PROMPT_TAIL)} AS prompt
FROM dl JOIN kl USING (topic_id)""")
def topic_prompt(spark, sf):
    """Cluster-labelling prompt per topic."""
    t = _with_prob(spark, sf)
    reps = tp.representative_rows(t, "topic_id", "doc_id", "p", "cleaned", 5)
    kws = tp.keyword_lists(tp.topic_keywords(t, "cleaned", "topic_id", 10, pre_cleaned=True), "topic_id")
    return tp.topic_prompt(reps, kws, "topic_id", "cleaned", 100)


@query("discovery_overview", """SELECT count(*) AS total,
  count(DISTINCT CASE WHEN label <> 9 THEN label END) AS n_topics,
  count(*) FILTER (WHERE label = 9) AS n_outliers,
  round(100.0 * count(*) FILTER (WHERE label = 9) / count(*), 6) AS outlier_pct,
  round(100.0 * count(*) FILTER (WHERE label <> 9) / count(*), 6) AS coverage_pct
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""")
def discovery_overview(spark, sf):
    """E18."""
    return tp.discovery_overview(tb.topic_of_documents(spark, sf), "topic_id")


@query("topic_sizes", """SELECT CASE WHEN label = 9 THEN -1 ELSE label END AS topic_id, count(*) AS size,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) GROUP BY 1""")
def topic_sizes(spark, sf):
    """E19."""
    return tp.topic_sizes(tb.topic_of_documents(spark, sf), "topic_id")


@query("discovery_report", f"""WITH {MEMB_SQL}, {_kw_sql('tr', 'topic_id', 10)},
kl AS (SELECT topic AS topic_id, list(term ORDER BY rank) AS kws FROM kw GROUP BY topic),
sizes AS (SELECT topic_id, count(*) AS size, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
          FROM tr GROUP BY topic_id),
named AS (SELECT s.topic_id, s.size, s.pct, coalesce(kl.kws, []) AS kws,
                 CAST(s.topic_id AS VARCHAR) || CASE WHEN len(coalesce(kl.kws, [])) > 0
                   THEN '_' || array_to_string(kl.kws[1:4], '_') ELSE '' END AS name
          FROM sizes s LEFT JOIN kl USING (topic_id)),
ex AS (SELECT topic_id,
         max(CASE WHEN rep_rank = 1 THEN substring(cleaned, 1, 80) END) AS example_1,
         round(max(CASE WHEN rep_rank = 1 THEN p END), 6) AS score_1,
         max(CASE WHEN rep_rank = 2 THEN substring(cleaned, 1, 80) END) AS example_2,
         round(max(CASE WHEN rep_rank = 2 THEN p END), 6) AS score_2,
         max(CASE WHEN rep_rank = 3 THEN substring(cleaned, 1, 80) END) AS example_3,
         round(max(CASE WHEN rep_rank = 3 THEN p END), 6) AS score_3
       FROM reps WHERE rep_rank <= 3 GROUP BY topic_id)
SELECT n.topic_id, {_label_report_sql('n.topic_id', 'n.name')} AS label, n.size, n.pct,
       array_to_string(n.kws[1:5], ', ') AS keywords, ex.example_1, ex.score_1, ex.example_2, ex.score_2,
       ex.example_3, ex.score_3
FROM named n JOIN ex USING (topic_id) WHERE n.topic_id <> -1""")
def discovery_report(spark, sf):
    """One row per discovered topic — label, size, %, top-5 keywords and
    three example sentences with their scores."""
    t = _with_prob(spark, sf)
    info = tp.topic_info(t, "cleaned", "topic_id", 10, pre_cleaned=True)
    return tp.discovery_report(t, "topic_id", "doc_id", "p", "cleaned", info)
