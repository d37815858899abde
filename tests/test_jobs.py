"""The predict job: columns, decisions and when the generator is asked."""

from utterscope.config import InferenceSettings
from utterscope.operators import jobs
from utterscope.operators import prep as pp


def inputs(spark):
    rows = [(1, "Buongiorno allora il terminale non stampa", [9.0, 0.0], "A"), (2, "ciao", [0.0, 9.0], "B"), (3, None, [0.1, 0.0], ""),
            (4, "  ", [9.0, 0.0], "B"), (5, "vorrei sapere il saldo del conto", [0.0, 9.0], None)]
    frame = spark.createDataFrame(rows, "ID long, Testo string, logits array<double>, `Bot Topic` string")
    dim = spark.createDataFrame([("A", "guasti", 1)], "intent string, description string, priority int")
    return frame, dim


def run(spark, generator):
    frame, dim = inputs(spark)
    named = jobs.F.array(jobs.F.lit("A"), jobs.F.lit("NOMATCH"))
    out = jobs.predict_report(frame, lambda r: r.withColumn("class_names", named), InferenceSettings(temperature=1.0),
                              ["Interaction ID"], dim, make_generator=generator)
    assert out.columns == jobs.REPORT_COLUMNS
    return {r["Interaction ID"]: r for r in out.collect()}


def test_report_of_eight_columns(spark):
    def shouting():  # nested, so that it travels to the workers by value
        return lambda messages: messages[-1]["content"].removeprefix("Input: ").upper()

    got = run(spark, shouting)
    assert [got[i]["Phrase normalized"] for i in range(1, 6)] == [
        "IL TERMINALE NON STAMPA", "ciao", "", "", "VORREI SAPERE IL SALDO DEL CONTO"]
    assert [got[i]["Topic tool"] for i in range(1, 6)] == ["A", "NOMATCH", "UNLISTED", "A", "NOMATCH"]
    assert [got[i]["Summary"] for i in range(1, 6)] == ["MATCH_BOT", "NO_MATCH", "UNLISTED", "MISMATCH", "NO_MATCH"]
    assert got[1]["Confidence"] == 10.0 and got[3]["Date/time"] == "timestamp_3" and got[5]["Topic bot"] == ""


def test_a_failing_generator_falls_back_to_the_rules(spark):
    def failing():
        def generate(messages):
            raise RuntimeError("no model")
        return generate

    got = run(spark, failing)
    assert got[1]["Phrase normalized"] == "il terminale non stampa" and got[2]["Phrase normalized"] == "ciao"


def test_only_rows_with_words_need_the_generator(spark):
    rows = [("a b c", "a b c"), ("a b", "a b"), ("", ""), (None, None), ("ciao", "")]
    frame = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in frame.select(pp.needs_generation("t", "c")).collect()] == [True, False, False, False, False]


def test_evaluation_of_several_settings(spark):
    rows = [(1, "A", [3.0, 0.0]), (2, "A", [0.0, 3.0]), (3, "B", [0.0, 0.1]), (4, "B", [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "id long, true_label string, logits array<double>").withColumn(
        "class_names", jobs.F.array(jobs.F.lit("A"), jobs.F.lit("B")))
    got = jobs.evaluate(frame, "id", [(1.0, 0.65), (1.0, 0.0)])
    assert [got[c]["accuracy"].first()["accuracy"] for c in got] == [0.5, 0.75]
    strict = got[1.0, 0.65]
    report = {r["label"]: r for r in strict["classification_report"].collect()}
    assert report["A"]["precision"] == 1.0 and report["A"]["recall"] == 0.5 and report["accuracy"]["f1"] == 0.5
    assert {(r["true_label"], r["pred_label"]): r["n"] for r in strict["confusion_matrix"].collect() if r["n"]} == {
        ("A", "A"): 1, ("A", "B"): 1, ("B", "UNLISTED"): 1, ("B", "B"): 1}
    assert [r["id"] for r in strict["errors"].collect()] == [3, 2] and [r["id"] for r in strict["top_errors"].collect()] == [2]
    assert strict["error_summary"].first()["errors"] == 2 and got[1.0, 0.0]["histogram"].count() == 20
