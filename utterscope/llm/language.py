"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Training: follow-the-regularised-leader with elastic-net penalties on shards
of a bounded sample of labelled documents, the shard weights averaged.
Document frequencies come from all learning documents.  A temperature fitted
on documents kept out of training calibrates the probabilities.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import map_texts, texts
from utterscope.llm.rows import keep_rows
from utterscope.session import reliable_checkpoint

UNKNOWN = "und"
BITS = 15
BUCKETS = 1 << BITS
ORDERS = (2, 3)
SCALE = 50.0  # size of a document's feature vector; FTRL's rates are set for it
SEGMENT = 1 << 20  # code points that are turned into n-grams at a time

# letters below U+0250 keep their code, other characters there become a space
_CLASS = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, set(text)))


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed character n-grams of the lower-cased text, in stretches."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    for at in range(0, len(codes), SEGMENT):
        part = codes[max(0, at - max(ORDERS) + 1):at + SEGMENT]
        part = np.where(part < 0x250, _CLASS[np.minimum(part, 0x24F)], part)
        for n in ORDERS:
            if len(part) >= n:
                mixed = part[:len(part) - n + 1] * np.uint32(0x9E3779B1)
                for k in range(1, n):
                    mixed = (mixed ^ part[k:len(part) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                yield mixed >> np.uint32(32 - BITS)


def _count_documents(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents, over the whole table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for b in batches:
            for t in b.column(1).to_pylist():
                seen = np.zeros(BUCKETS + 1, dtype=bool)
                for g in gram_buckets(t):
                    seen[g] = True
                seen[BUCKETS] = True  # the last entry counts documents
                held += seen
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": held[at]})

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n  # one row per bucket, BUCKETS + 1 at most
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class LanguageModel:
    """Languages, weight of each bucket's term frequency per language, and
    the temperature of the logits."""

    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, inverse document frequency included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for g in gram_buckets(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 where the text
        has no letter or nothing was learnt."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        return self.languages[int(z.argmax())], float(p.max() / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float, beta: float,
         l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights (BUCKETS + 1 rows, the last the bias) after ``epochs`` passes
    of per-coordinate FTRL-proximal over (buckets, values, class)."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def weights(at):
        root = np.sqrt(n[at])
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + root) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    return weights(np.arange(BUCKETS + 1))


def fit_language_model(docs: DataFrame, sample_per_language: int = 1500, shards: int = 8, alpha: float = 0.5,
                       beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4,
                       calibrate: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> LanguageModel:
    """Fit on ``docs``, all of which may be learnt from; rows without a label
    or a letter teach nothing.

    The weights are fitted on a sample of about ``sample_per_language``
    documents of each language, chosen by a hash of their id (a bound in
    documents, whole texts); document frequencies on all of them; the
    temperature on as large a sample of the rows where ``calibrate`` holds,
    which train nothing.  No labelled row at all gives a model that answers
    ``und``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"),
                       F.coalesce(calibrate, F.lit(False)).alias("fold") if calibrate is not None
                       else F.lit(False).alias("fold")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {(r.lang, r.fold): r.n for r in rows.groupBy("lang", "fold").agg(F.count("*").alias("n")).collect()}
    languages = sorted({lang for lang, _ in sizes})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    if len(languages) > 1000:
        raise ValueError("over 1000 languages: the label column doesn't hold languages")

    # a hash below the share that gives each language its sample
    share = F.create_map(*itertools.chain.from_iterable(
        (F.lit(f"{lang}:{int(fold)}"), F.lit(min(1.0, sample_per_language / n))) for (lang, fold), n in sizes.items()))
    key = F.concat_ws(":", "lang", F.col("fold").cast("int").cast("string"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = reliable_checkpoint(rows.filter(draw < share[key]))
    held, n_docs = _count_documents(texts(rows))
    idf = np.log((1.0 + n_docs) / (1.0 + held)) + 1.0
    code = {lang: i for i, lang in enumerate(languages)}

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = sum((np.bincount(g, minlength=BUCKETS) for g in gram_buckets(text)), np.zeros(BUCKETS))
        at = np.flatnonzero(counts)
        x = counts[at] / max(counts.sum(), 1) * idf[at] * SCALE
        return np.append(at, BUCKETS), np.append(x, 1.0)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "lang", "text"])
        data = [(*features(t), code[lang]) for t, lang in zip(pdf.text, pdf.lang) if has_letter(t)]
        w = ftrl(data, len(languages), alpha, beta, l1, l2, epochs)
        at, c = np.nonzero(w)
        return pd.DataFrame({"n": len(data), "bucket": at, "class": c, "w": w[at, c]})

    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")
    trained = (sample.filter("NOT fold").select(shard.alias("shard"), F.xxhash64("doc_id", F.lit("order")).alias("order"), "text", "lang")
               .groupBy("shard").applyInPandas(train, "n long, bucket int, class int, w double"))
    averaged = trained.groupBy("bucket", "class").agg((F.sum("w") / shards).alias("w")).toPandas()
    w = np.zeros((BUCKETS + 1, len(languages)))
    w[averaged["bucket"], averaged["class"]] = averaged["w"]
    model = LanguageModel(languages, (w[:BUCKETS] * idf[:, None] * SCALE).astype(np.float32), w[BUCKETS])
    model.temperature = _temperature(sample.filter("fold"), model, code)
    return model


def _temperature(rows: DataFrame, model: LanguageModel, code: dict[str, int]) -> float:
    """The temperature of a grid with the least negative log-likelihood; 1
    without rows."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 61))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(t):
                    z = model.logits(t)[None, :] / grid[:, None]
                    z -= z.max(axis=1, keepdims=True)
                    total += np.log(np.exp(z).sum(axis=1)) - z[:, code[lang]]
                    n += 1
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(grid), dtype=np.int32), "nll": total,
                                          "n": np.full(len(grid), n, dtype=np.int64)})

    found = rows.select("text", "lang").mapInArrow(run, "at int, nll double, n long").groupBy("at").agg(
        F.sum("nll").alias("nll"), F.sum("n").alias("n")).orderBy("nll", "at").first()
    return float(grid[found.at]) if found is not None and found.n else 1.0


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of every whole text and its
    calibrated probability.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learnt; ties go to the language that comes first in order; null ids,
    repeated rows and empty tables stay; other columns are left out.  Only
    the text is read.  The model is broadcast: 2^15 weights per language,
    1000 languages at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(ids: list, values: list) -> dict:
        found = [shared.value.predict(t) for t in values]
        return {"doc_id": pa.array(ids, type=pa.int64()),
                "lang_pred": pa.array([f[0] for f in found], type=pa.string()),
                "score": pa.array([f[1] for f in found], type=pa.float64())}

    return map_texts(texts(docs, id_col, text_col), batch, "doc_id long, lang_pred string, score double")


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null without id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def learn_and_predict(docs: DataFrame, sample_per_language: int = 1500, **columns) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for all of ``docs``, learnt from
    the rows outside fold 0; fold 1 calibrates.  A row without an id is never
    learnt from and counts as held out."""
    fold = fold_of(columns.get("id_col", "doc_id"))
    model = fit_language_model(docs.filter(fold != 0), sample_per_language, calibrate=fold == 1, **columns)
    columns.pop("lang_col", None)
    return predict_language(docs, model, **columns).select(
        "doc_id", F.coalesce(fold_of() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, over_chance: float = 1.2, sample_per_language: int = 1500, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is identified: texts that are null
    or without a letter are rejected, and those for which no language is
    ``over_chance`` times as probable as if all languages were alike.  Learns
    as ``learn_and_predict`` does; if no row has a label, every text with a
    letter stays."""
    fold = fold_of(id_col)
    model = fit_language_model(docs.filter(fold != 0), sample_per_language, calibrate=fold == 1,
                               id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(values: list) -> list:
        if not shared.value.languages:
            return [has_letter(t) for t in values]
        least = min(over_chance / len(shared.value.languages), 1 - 1e-9)
        return [lang != UNKNOWN and score >= least for lang, score in map(shared.value.predict, values)]

    return keep_rows(docs, text_col, keep)
