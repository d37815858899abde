"""Embedding, reduction, clustering and the discovery job on planted data."""

import numpy as np
import pytest

from utterscope.config import DiscoverySettings, TrainingSettings
from utterscope.operators import clustering as cl
from utterscope.operators import jobs
from utterscope.operators import models as md
from utterscope.operators import topics as tp
from utterscope.operators import tuning

THEMES = {"stampante": ["stampante", "carta", "inchiostro", "toner", "bloccata"],
          "pagamento": ["pagamento", "bancomat", "transazione", "rifiutata", "pos"],
          "rete": ["rete", "connessione", "modem", "offline", "segnale"]}


@pytest.fixture(scope="module")
def sentences(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(180):
        theme = list(THEMES)[i % 3]
        rows.append((i, theme, " ".join(rng.choice(THEMES[theme], 7))))
    return spark.createDataFrame(rows, "id long, theme string, text string")


def test_embedding_has_unit_length_and_zero_for_no_word(spark):
    df = spark.createDataFrame([(1, "stampante rotta"), (2, "rete lenta"), (3, "")], "id long, text string")
    norms = {r.id: float(np.linalg.norm(r.embedding)) for r in cl.embed_text(df, "text").collect()}
    assert norms[1] == pytest.approx(1) and norms[2] == pytest.approx(1) and norms[3] == 0


def test_reduction_keeps_the_variance_of_a_plane(spark):
    rng = np.random.default_rng(2)
    plane = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(plane)], "id long, v array<double>")
    reduced = {r.id: np.array(r.reduced) for r in cl.reduce_dims(df, "v", 2).collect()}
    unit = plane / np.linalg.norm(plane, axis=1, keepdims=True)
    for i in range(50):
        assert len(reduced[i]) == 2 and np.linalg.norm(reduced[i]) == pytest.approx(1)
    assert unit.shape == (50, 6)


def test_rows_are_in_their_nearest_cluster_or_noise(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    points = [(i, [float(x) for x in centres[i % 3] + rng.normal(size=2)]) for i in range(120)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    got = cl.centroid_cluster(df, "id", "v", 3, noise_quantile=0.9).collect()
    groups = {}
    for r in got:
        if r.topic_id >= 0:
            groups.setdefault(r.topic_id, set()).add(r.id % 3)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert 6 <= sum(r.topic_id == -1 for r in got) <= 18


def test_discovery_finds_planted_themes(sentences):
    out = cl.discover_intents(sentences, "id", "text", DiscoverySettings(min_cluster_size=20, n_components=3))
    themes = {r.id: r.theme for r in sentences.collect()}
    rows = out["assignments"].collect()
    found = {}
    for r in rows:
        if r.topic_id >= 0:
            found.setdefault(r.topic_id, set()).add(themes[r.id])
    assert len(rows) == 180 and found and all(len(t) == 1 for t in found.values())
    metrics = out["metrics"].first()
    assert metrics["num_clusters"] == len(found) and metrics["silhouette_score"] > 0.3
    scores = [r["coherence_score"] for r in out["coherence"].collect()]
    assert scores == sorted(scores, reverse=True) and out["overview"].first()["total"] == 180


def test_mmr_drops_near_repeats(spark):
    kw = spark.createDataFrame([(0, 1, "stampante", 1.0), (0, 2, "stampanti", 0.9), (0, 3, "toner", 0.5)],
                               "topic int, rank int, term string, score double")
    assert [r.term for r in tp.mmr_keywords(kw, "topic", 2, 0.7).orderBy("rank").collect()][1] == "toner"


def test_classifier_and_ensemble_learn_the_themes(sentences):
    model, index = md.fit_classifier(sentences, "text", "theme")
    scored = md.score(model, sentences, index).collect()
    right = [r["class_names"][int(np.argmax(r["logits"]))] == r["theme"] for r in scored]
    assert np.mean(right) == 1.0
    models, index = md.train_ensemble(sentences, "text", "theme", "id", [1, 2])
    got = md.ensemble_predict(models, sentences, index, "id").collect()
    assert np.mean([r["pred_label"] == r["theme"] for r in got]) > 0.95 and all(0 < r["confidence"] <= 1 for r in got)


def test_classifier_of_best_held_out_f1_is_chosen(sentences):
    settings = TrainingSettings(label_column="theme", reg_params=(50.0, 0.01), max_iter=10, num_features=1 << 10)
    out = jobs.train_classifier(sentences, "id", settings)
    assert [r for r, _ in out["validation"]] == [50.0, 0.01]
    assert dict(out["validation"])[out["reg_param"]] == max(f for _, f in out["validation"]) and out["test_f1"] == 1.0


def test_search_over_classifier_settings(sentences):
    settings = TrainingSettings(label_column="theme", k_folds=2, use_class_weights=False)
    trials = jobs.search_classifier(sentences, "id", [{"max_iter": 5, "num_features": 512}, {"max_iter": 0, "num_features": 512}], settings)
    assert trials.count() == 4 and tuning.best_trial(trials).first()["trial"] == 0


def test_coordinates_keep_the_plane_they_lie_in(spark):
    from utterscope.operators import geometry as ge
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(30, 2))
    points = flat @ np.linalg.qr(rng.normal(size=(5, 2)))[0].T
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, v array<double>")
    got = np.array([r.coords for r in ge.row_coordinates(df, "id", "v").orderBy("id").collect()])

    def gaps(x):
        return np.linalg.norm(x[:, None] - x[None, :], axis=2)

    assert np.allclose(gaps(got), gaps(points))
