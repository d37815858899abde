"""Text rules on utterances whose results were worked out by hand."""

import pytest

from utterscope.functions import text as tx

# utterance, without fillers, normalised
NORMALISED = [
    ("Buongiorno, volevo sapere il saldo del conto", ", il saldo del conto", ", il saldo del conto"),
    ("Salve, mi serve un operatore umano", ", un operatore umano", ", un operatore umano"),
    ("allora dunque il pos\tnon va", "il pos non va", "il pos non va"),
    ("cioè la tv è rotta", "la tv è rotta", "la tv è rotta"),
    ("Scusi, sto chiamando per il collega", ", il collega", ", il collega"),
    ("avrei bisogno di una ricevuta per il pagamento", "una ricevuta per il pagamento", "una ricevuta per il pagamento"),
    ("desideravo informazioni sul gratta vinci", "informazioni sul gratta vinci", "informazioni sul gratta vinci"),
    ("ecco senta guardate qui ora", "guardate qui ora", "guardate qui ora"),  # whole words only
    ("va bene grazie", "va bene", "va bene grazie"),  # under three words: as it was
    ("PRONTO? Buonasera!", "? !", "PRONTO? Buonasera!"),
    ("ciao", "", "ciao"),
    ("", "", ""),
    (None, None, ""),
]

# utterance, cleaned for discovery
CLEANED = [
    ("Buongiorno, volevo sapere il saldo del conto", "volevo sapere saldo conto"),
    ("10 e lotto non funziona", "diecielotto non funziona"),
    ("10 e l'otto non funziona", "lotto non funziona"),  # the later rewrite comes too late for the earlier
    ("ho un gratta e vinci vincente", "ho grattaevinci vincente"),
    ("grattini e million day", "grattaevinci millionday"),
    ("cioè la tv è rotta", "cioè monitor rotta"),
    ("sì vabbè la stampantina non stampa", "stampante non stampa"),
    ("va bene grazie", "va bene"),
    ("123 456 pos", "pos"),
    ("Il display del terminale è nero", "monitor terminale nero"),
    ("time out sulla vincite", "timeout vincita"),
    ("ribbon finiti, nastri e rulli", "cartucce finiti cartucce cartucce"),
    ("Scusi, sto chiamando per il collega", "scusi sto chiamando operatore"),
    ("L OTTO non esce", "lotto non esce"),
    ("persona cristiano human", "operatore operatore operatore"),
    ("Salve, mi serve un operatore umano", "mi serve operatore operatore"),
    ("desideravo informazioni sul gratta vinci", "desideravo informazioni sul grattaevinci"),
    ("Perché l'ordine n° 5 è caro?", "perché ordine caro"),
    ("eh ehm ok certo dimmi", ""),
    ("", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    def of(rows, *columns):
        df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
        return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]
    return of


def test_fillers_are_stripped_and_short_rests_left_as_they_were(outcomes):
    got = outcomes(NORMALISED, tx.strip_fillers("t"), tx.normalise_rule_based("t"))
    assert got == [(s, n) for _, s, n in NORMALISED]


def test_discovery_cleaning(outcomes):
    assert [c for c, in outcomes(CLEANED, tx.clean_for_discovery("t"))] == [c for _, c in CLEANED]


def test_rewrite_order(spark):
    df = spark.createDataFrame([("10 e lotto",), ("10 e l'otto",), ("gratta e vinci",), ("gratta",)], "t string")
    got = [r[0] for r in df.select(tx.clean_for_discovery("t")).collect()]
    assert got == ["diecielotto", "lotto", "grattaevinci", "grattaevinci"]


def test_validate_and_guard(spark):
    df = spark.createDataFrame([(None,), ("  abc  ",), ("x" * 600,)], "t string")
    got = [r[0] for r in df.select(tx.validate_text("t", 512)).collect()]
    assert got == ["", "abc", "x" * 512]
    g = spark.createDataFrame([("a" * 5, "b" * 5), ("a" * 9, "b" * 6), ("a" * 10, "b" * 6), (None, "fallback")],
                              "out string, fb string")
    got = [r[0] for r in g.select(tx.guard_generated("out", "fb")).collect()]
    # fallback length 5: guard off; 6: 1.5x = 9 kept, 10 rejected; error -> fallback
    assert got == ["a" * 5, "a" * 9, "b" * 6, "fallback"]


def test_topic_label_cleaners(spark):
    rows = [(0, "0_foo_bar"), (10, "10 e lotto_x"), (3, "\"carta\"_l'otto"), (-1, "-1_noise"), (7, None)]
    df = spark.createDataFrame(rows, "t int, name string")
    got = df.select(tx.topic_label_report("t", "name").alias("r"), tx.topic_label_output("t", "name").alias("o")).collect()
    assert [g["r"] for g in got] == ["foo bar", "10 e lotto x", "carta l otto", "NOISE", "Topic 7"]
    assert [g["o"] for g in got][:4] == ["foo bar", "e lotto x", "carta lotto", "NOISE"]
    words = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "w array<string>")
    assert words.select(tx.first_words("w", 3)).first()[0] == "a b c"


def test_generated_text_reads_few_messages_at_a_time(spark):
    """What stands in Python at once is bounded, whatever the Arrow batch."""
    from pyspark.sql import functions as F
    from utterscope.operators import prep as pp

    def counting():
        import gc
        seen = []

        def generate(messages):
            if not seen:  # once: slow
                seen.append(sum(1 for x in gc.get_objects() if type(x) is dict and set(x) == {"role", "content"}))
            return str(seen[0] <= 2000)
        return generate

    df = spark.range(0, 3000, 1, 1).select(F.col("id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("a").alias("content"))).alias("messages"),
                                           F.lit("abc").alias("fallback"))
    got = pp.generate_text(df.filter("id % 500 = 0").union(df).coalesce(1), make_generator=counting).groupBy("generated").count().collect()
    assert {r["generated"]: r["count"] for r in got} == {"True": 3006}
