"""Spark ML model jobs.

The transformer fine-tuning of the reference is re-aimed at a Spark ML
text pipeline: tokenizer -> hashing TF -> IDF -> class-weighted logistic
regression.  Fitting is Spark's distributed treeAggregate; nothing is
collected besides the fitted coefficients.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators import splits as sp
from utterscope.operators import weights as wt
from utterscope.session import sized_broadcast, written_table


def text_pipeline(text: str, num_features: int = 1 << 16, reg_param: float = 0.01,
                  max_iter: int = 50, weight_col: str | None = "weight", elastic_net: float = 0.0) -> Pipeline:
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol="label_id", maxIter=max_iter,
                            regParam=reg_param, elasticNetParam=elastic_net, family="multinomial")
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[tok, tf, idf, lr])


def fit_classifier(df: DataFrame, text: str, label: str, use_weights: bool = True, **kw):
    """(model, label_index).  Class weights (E2) enter as a weight column."""
    index = sp.label_index(df, label)
    x = sp.map_labels(df, label, index, default=None)
    if use_weights:
        w = wt.class_weights(df, label).select(F.col(label).cast("string").alias("_l"), "weight")
        x = x.join(sized_broadcast(w, 1 << 20), F.col(label).cast("string") == F.col("_l")).drop("_l")
    pipeline = text_pipeline(text, weight_col="weight" if use_weights else None, **kw)
    tok, tf, idf, lr = pipeline.getStages()
    if counts_column(tf, text) not in df.columns:
        return pipeline.fit(x), index
    x = x.select("label_id", F.col(counts_column(tf, text)).alias("_tf"), *(["weight"] if use_weights else []))
    idf = idf.fit(x)
    return PipelineModel([tok, tf, idf, lr.fit(idf.transform(x))]), index


def counts_column(tf: HashingTF, text: str) -> str:
    """Where ``counted`` keeps the term counts of a text."""
    return f"_tf_{text}_{tf.getNumFeatures()}"


def counted(df: DataFrame, text: str, sizes) -> DataFrame:
    """``df`` as a written table with the term counts of ``text``, a column
    for each number of features in ``sizes``, in place of the text; ``_row``
    numbers the rows.  Many fits and scores so read every text once."""
    out = df
    for n in sorted(set(sizes)):
        tok, tf, *_ = text_pipeline(text, num_features=n).getStages()
        out = tf.setOutputCol(counts_column(tf, text)).transform(out if "_tokens" in out.columns else tok.transform(out))
    return written_table(out.drop("_tokens", text).withColumn("_row", F.monotonically_increasing_id()), "counted")


def with_flags(rows: DataFrame, keys: list[str], flags) -> DataFrame:
    """Counted rows, written with what each function in ``flags`` (name ->
    function) says of their ``keys``; only these are sorted."""
    out = rows
    for name, told in flags.items():
        out = out.join(told(rows.select("_row", *keys)).withColumnRenamed(name, "_flag").select(
            "_row", F.col("_flag").alias(name)), "_row")
    return written_table(out, "flagged")


def predicted(model, df: DataFrame) -> DataFrame:
    """``model.transform``; from the term counts where ``df`` holds them."""
    tok, tf, *rest = model.stages
    column = counts_column(tf, tok.getInputCol())
    return PipelineModel(rest).transform(df.withColumn("_tf", F.col(column))) if column in df.columns else model.transform(df)


def score(model, df: DataFrame, index: DataFrame) -> DataFrame:
    """Logits (raw prediction) per row + class names in id order."""
    out = predicted(model, df).withColumn("logits", vector_to_array("rawPrediction"))
    names = index.agg(F.sort_array(F.collect_list(F.struct("label_id", "label"))).alias("_n"))
    out = out.withColumn("_n", names.scalar()).withColumn("class_names", F.transform("_n", lambda e: e["label"]))
    return out.drop("_n", "_tokens", "_tf", "_features", "rawPrediction", "probability", "prediction")


def train_ensemble(df: DataFrame, text: str, label: str, key: str, seeds: list[int],
                   frac: float = 0.10, **kw):
    """One model per seed, each fitted on its own stratified train split.
    Texts are read once, unless ``df`` is ``counted`` already."""
    models = []
    index = sp.label_index(df, label)
    rows = df if "_row" in df.columns else counted(df.select(key, label, text), text, [_features(text, **kw)])

    def split(s):
        return lambda r: sp.stratified_split(r, label, key, frac, s).withColumnRenamed("is_test", f"_test{s}")

    rows = with_flags(rows, list(dict.fromkeys([key, label])), {f"_test{s}": split(s) for s in seeds})
    for s in seeds:
        m, _ = fit_classifier(rows.where(~F.col(f"_test{s}")), text, label, **kw)
        models.append(m)
    return models, index


def _features(text: str, use_weights: bool = True, **kw) -> int:
    """The number of features that ``fit_classifier`` counts by."""
    return text_pipeline(text, **kw).getStages()[1].getNumFeatures()


def ensemble_predict(models, df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """C9 over fitted models: element-wise mean of logits, then argmax.  The
    models run one after the other over the same rows, of which only the
    logits are kept; nothing is joined."""
    out, cols = df, []
    for m in models:  # each text is counted once for all models that count alike
        tok, tf, *_ = m.stages
        column = counts_column(tf, tok.getInputCol())
        if column not in out.columns:
            counts = tf.copy().setOutputCol(column).transform(tok.transform(out))
            out = counts.select(*out.columns, column)
    for i, m in enumerate(models):
        made = predicted(m, out)
        out = made.select(*out.columns, vector_to_array("rawPrediction").alias(f"_lg{i}"))
        cols.append(f"_lg{i}")
    out = out.withColumn("logits", vx.elementwise_mean(cols)).drop(*cols).drop(*[c for c in out.columns if c not in df.columns])
    names = index.agg(F.sort_array(F.collect_list(F.struct("label_id", "label"))).alias("_n"))
    out = out.withColumn("_n", names.scalar())
    p = vx.softmax("logits", 1.0)
    return (out.withColumn("confidence", F.array_max(p))
               .withColumn("pred_label", F.element_at("_n", vx.argmax(p) + 1)["label"]).drop("_n"))
