"""Column expressions for utterance text (JVM-side, codegen friendly).

All regexes carry ``(?U)`` so that ``\\b``, ``\\w`` and ``\\s`` follow Unicode
rules (accented letters are word characters, non-breaking spaces are space).
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterscope.functions import lexicon as lx


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _alternation(words) -> str:
    return "|".join(words)


def unicode_strip(col) -> Column:
    """Strip leading/trailing Unicode whitespace (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def collapse_spaces(col) -> Column:
    return unicode_strip(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def tokens(col) -> Column:
    """Whitespace tokens without empties (``str.split()`` semantics)."""
    return F.filter(F.split(_c(col), r"(?U)\s+"), lambda w: w != "")


def word_count(col) -> Column:
    return F.size(tokens(col))


def validate_text(col, max_len: int = 512) -> Column:
    """null -> '', strip, keep the first ``max_len`` characters."""
    return F.substring(unicode_strip(F.coalesce(_c(col), F.lit(""))), 1, max_len)


def was_truncated(col, max_len: int = 512) -> Column:
    return F.length(unicode_strip(F.coalesce(_c(col), F.lit("")))) > max_len


def text_preview(col, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def strip_fillers(col, greetings=lx.GREETINGS, fillers=lx.FILLERS,
                  meta_talk=lx.META_TALK) -> Column:
    """Lower-case, delete whole-word greetings, fillers and meta talk (in
    that order), collapse whitespace."""
    out = F.lower(_c(col))
    for words in (greetings, fillers, meta_talk):
        out = replace_words(out, _alternation(words), "")
    return collapse_spaces(out)


def normalise_rule_based(col, min_words: int = 3, **lists) -> Column:
    """Rule-based normaliser: empty -> ''; cleaned text shorter than
    ``min_words`` words (or empty) -> the raw text; else the cleaned text.
    (When the cleaned text is already a column, use ``normalise_from_clean``
    so the regex chain runs once per row.)"""
    return normalise_from_clean(col, strip_fillers(_c(col), **lists), min_words)


def normalise_from_clean(raw, clean, min_words: int = 3) -> Column:
    r, c = _c(raw), _c(clean)
    return (F.when(r.isNull() | (r == ""), F.lit(""))
            .when((c == "") | (word_count(c) < min_words), r)
            .otherwise(c))


def guard_generated(generated, fallback, max_ratio: float = 1.5,
                    min_fallback_len: int = 5) -> Column:
    """Reject a generated text that is much longer than its short source."""
    g, fb = _c(generated), _c(fallback)
    too_long = (F.length(fb) > min_fallback_len) & (F.length(g) > F.length(fb) * max_ratio)
    return F.when(g.isNull() | too_long, fb).otherwise(g)


def computed_once(df, name: str, value: Column):
    """``df`` with column ``name`` made by a generator, through which no
    filter on the column is pushed: a costly ``value`` runs once per row."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def literal_parts(pattern: str) -> list[str] | None:
    """For each alternative of ``pattern`` the literal text it begins with;
    None when one begins with something else."""
    parts = []
    for alternative in pattern.split("|"):
        literal = re.match(r"[^\\\[\](){}.*+?^$]*", alternative).group()
        if alternative[len(literal):len(literal) + 1] in ("?", "*", "{"):
            literal = literal[:-1]
        if not literal:
            return None
        parts.append(literal)
    return parts


def replace_words(col: Column, pattern: str, repl: str) -> Column:
    """Replace whole words that match ``pattern``.  The regex, slow under
    Unicode word rules, runs only on texts that hold one of its literals, and
    there only where one of their first characters stands; the text is bound
    to a lambda variable so that it is computed once."""
    parts = literal_parts(pattern)
    whole = rf"(?U)\b({pattern})\b"
    if parts is None:
        return F.regexp_replace(col, whole, repl)
    whole = f"(?U)(?=[{''.join(re.escape(c) for c in sorted({p[0] for p in parts}))}])" + whole[4:]

    def step(text: Column) -> Column:
        held = reduce(or_, [text.contains(p) for p in dict.fromkeys(parts)])
        return F.when(held, F.regexp_replace(text, whole, repl)).otherwise(text)

    return F.element_at(F.transform(F.array(col), step), 1)


def discovery_rewrite(col, rewrites=lx.DOMAIN_REWRITES) -> Column:
    """Lower-case and apply the ordered domain rewrites."""
    out = F.lower(F.coalesce(_c(col), F.lit("")))
    for pattern, repl in rewrites:
        out = replace_words(out, pattern, repl)
    return out


def discovery_tokens(col, stopwords=lx.STOPWORDS, fillers=lx.VOICE_FILLERS,
                     rewrites=lx.DOMAIN_REWRITES, kept=lx.KEPT_CHARS) -> Column:
    """Cleaned discovery tokens: rewrites, drop characters outside the kept
    set, split, drop stopwords / voice fillers / 1-char / all-digit tokens."""
    text = F.regexp_replace(discovery_rewrite(col, rewrites), rf"(?U)[^{kept}\s]", " ")
    drop = list(dict.fromkeys(list(stopwords) + list(fillers)))
    # a number begins before ":", so few tokens meet the regex
    return F.filter(
        F.split(text, r"(?U)\s+"),
        lambda w: (F.length(w) > 1) & ((w >= ":") | ~w.rlike("^[0-9]+$")) & ~w.isin(*drop),
    )


def clean_for_discovery(col, **kw) -> Column:
    return F.array_join(discovery_tokens(col, **kw), " ")


def topic_label_report(topic_id, label) -> Column:
    """Report-side topic label: -1 -> NOISE, missing -> 'Topic {id}', drop a
    leading 'id_' prefix, quotes/underscores -> space, collapse."""
    t, lab = _c(topic_id), _c(label)
    clean = F.regexp_replace(lab, r"^\d+\s*[_-]\s*", "")
    clean = F.regexp_replace(clean, r"""[_'"]+""", " ")
    clean = collapse_spaces(clean)
    return (F.when(t == -1, F.lit(lx.NOISE_LABEL))
            .when(lab.isNull(), F.concat(F.lit("Topic "), t.cast("string")))
            .otherwise(clean))


def topic_label_output(topic_id, label) -> Column:
    """Output-side topic label: -1 -> NOISE, '_' -> space, quotes deleted,
    strip, drop leading digits, collapse."""
    t, lab = _c(topic_id), _c(label)
    clean = unicode_strip(F.regexp_replace(F.regexp_replace(lab, "_", " "), """["']""", ""))
    clean = F.regexp_replace(clean, r"^\d+\s*", "")
    clean = F.regexp_replace(clean, r"(?U)\s+", " ")
    return F.when(t == -1, F.lit(lx.NOISE_LABEL)).otherwise(clean)


def first_words(words, n: int) -> Column:
    """Join the first ``n`` entries of a keyword array with spaces."""
    return F.array_join(F.slice(_c(words), 1, n), " ")
