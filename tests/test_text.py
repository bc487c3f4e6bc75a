from pyspark.sql import functions as F

from threadtide.functions import text
from threadtide.functions.lexicon import ALPHA, Lexicon, sentiment
from threadtide.operators import selection


def test_clean_text(values):
    rows = [
        "See HTTPS://x.y/a b", "awwww.site yes", "@name hi #tag", "don't a1b2", "x y \t z", "１２ok", "“Hi” – there",
        "!!! ...", "", None, "TAIL http://z",
    ]
    assert values(rows, text.clean_text) == [
        "see b", "a yes", "hi tag", "dont ab", "x y z", "ok", "“hi” – there", "", "", None, "tail",
    ]


def test_preprocess_text(values):
    rows = ["The cats and the cats!", "the and of", "I cannot, gonna", "“cities” boxes", None, ""]
    assert values(rows, text.preprocess_text) == ["cat cat", "", "gon na", "“ city ” box", "", ""]
    lemmas = lambda c: text.preprocess_text(c, lemmas={"mice": "mouse"}, suffix_rules=False)
    assert values(["mice cats mice"], lemmas) == ["mouse cats mouse"]


def test_counts(values):
    rows = ["", "  a  b ", "😀", "x y", None, "\t"]
    assert values(rows, text.char_count) == [0, 7, 1, 3, 0, 1]
    assert values(rows, text.word_count) == [0, 2, 1, 2, 0, 0]


def test_contains_word(values):
    rows = ["dogs", "OG!", "ab1- x", "v.p", "vxp", "éog", "og_", None, ""]
    assert values(rows, lambda c: text.contains_word(c, ["og"])) == [False, True, False, False, False, False, False, False, False]
    # an entry that ends in punctuation needs a word character behind it
    assert values(["ab1- x", "ab1-x"], lambda c: text.contains_word(c, ["ab1-"])) == [False, True]
    assert values(rows, lambda c: text.contains_word(c, ["v.p"]))[3:5] == [True, False]
    assert values(rows, lambda c: text.contains_word(c, [])) == [False] * len(rows)


def test_long_list_agrees_with_regex(values):
    entries = ["og", "v.p", "two words", "été", "ab1-", "x²"] + [f"w{i}" for i in range(40)]
    rows = ["dogs og", "OG!", "v.p", "Two words", "twowords", "été", "étéx", "w39.", "w390", "ab1-x", "a_og", None, "x²y", "x²"]
    long = values(rows, lambda c: text.contains_word(c, entries))
    parts = [values(rows, lambda c, e=e: text.contains_word(c, [e])) for e in entries]
    assert long == [any(p[i] for p in parts) for i in range(len(rows))]
    assert long == [True, True, True, True, False, True, False, True, False, True, False, False, True, False]


def test_post_type(spark):
    kinds = {"Move": ["win"], "Result": ["final"]}
    rows = [("Winter is here", "x"), ("The final win", ""), ("Grand FINAL", None), (None, None), ("nothing", "else")]
    df = spark.createDataFrame(rows, "t string, b string").select(text.post_type("t", "b", kinds).alias("k"))
    assert [r["k"] for r in df.collect()] == ["Move", "Move", "Result", "Other", "Other"]
    assert df.sparkSession.range(1).select(text.post_type(F.lit("a"), F.lit("b"), {}).alias("k")).first()["k"] == "Other"


def test_question(values):
    assert values([None, "?", "no", "a? b"], text.contains_question) == [False, True, False, True]


def test_selection_edges(spark):
    rows = [(1, None, "bob"), (2, "", "bob"), (3, "  ", None), (4, "\t\n", "bob"), (5, " ", "bob"), (6, "ok", "[deleted]"), (7, " ok ", None)]
    df = spark.createDataFrame(rows, "i int, body string, author string")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(selection.drop_blank(df, "body")) == [6, 7]
    assert ids(selection.drop_deleted(df, "author")) == [1, 2, 3, 4, 5, 7]
    trimmed = selection.trim_and_drop_empty(df, "body")
    assert {r["i"]: r["body"] for r in trimmed.collect()} == {6: "ok", 7: "ok"}
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "i int, v double")
    assert ids(selection.require(nan, "v")) == [2]


LEX = Lexicon({"good": 2.0, "bad": -2.5, "fine": 1.0})


def scores(values, rows, lexicon=LEX):
    return [(r["neg"], r["neu"], r["pos"], r["compound"]) for r in values(rows, lambda c: sentiment(c, lexicon))]


def compound(s):
    return round(s / (s * s + ALPHA) ** 0.5, 4)


def test_sentiment_rules(values):
    rows = ["", None, "unknown words", "good", "never good", "never xx good", "never xx yy good", "never xx yy zz good",
            "very good", "very xx good", "hardly good", "very bad", "least good", "good bad", "bad good", "a good"]
    got = scores(values, rows)
    assert got[0] == got[1] == (0.0, 0.0, 0.0, 0.0)
    assert got[2] == (0.0, 1.0, 0.0, 0.0)
    assert got[3] == (0.0, 0.0, 1.0, compound(2.0))
    for i in (4, 5, 6):
        assert got[i][3] == compound(2.0 * -0.74)
    assert got[7][3] == compound(2.0)
    assert got[8][3] == compound(2.0 + 0.293)
    assert got[9][3] == compound(2.0 + 0.293 * 0.95)
    assert got[10][3] == compound(2.0 - 0.293)
    assert got[11][3] == compound(-2.5 - 0.293)
    assert got[12][3] == compound(2.0 * -0.74)
    assert got[13] == got[14] == (round(3.5 / 6.5, 3), 0.0, round(3.0 / 6.5, 3), compound(-0.5))
    # one-letter tokens are not counted
    assert got[15] == got[3]


def test_sentiment_of_a_long_text_is_linear(spark):
    words = " ".join(["good", "word"] * 20_000)
    df = spark.createDataFrame([(words,)], "x string").select(sentiment(F.col("x"), LEX).alias("s"))
    # the filter makes the optimizer repeat the expression; it must not nest it
    assert df.where(F.col("s")["compound"] > 0.9).count() == 1


def test_lexicon_table(spark):
    table = spark.createDataFrame([("good", 1.5), ("bad", -1.0)], "term string, valence double")
    assert dict(Lexicon.from_table(table).valence) == {"good": 1.5, "bad": -1.0}


def test_dictionary_lemmas(spark):
    from threadtide.operators.lemmas import dictionary_lemmas, lemmatize_with_dictionary

    words = ["cat", "wolf", "man", "city", "bus", "box", "dress", "class", "geese", "goose", "as", "a", None, "cat"]
    dictionary = spark.createDataFrame([(w, 1) for w in words], "word string, token int")
    tokens = ["cats", "cats", "wolves", "men", "cities", "bus", "buses", "boxes", "dresses", "geese", "as", "catss", "unknowns", "s", "", None]
    odd = spark.createDataFrame([("geese", "goose"), ("men", "nobody"), (None, "cat")], "token string, lemma string")
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {r["token"]: r["lemma"] for r in dictionary_lemmas(frame, dictionary).collect()}
    assert got == {"cats": "cat", "wolves": "wolf", "men": "man", "cities": "city", "bus": "bus", "buses": "bus", "boxes": "box",
                   "dresses": "dress", "geese": "geese", "as": "a", "catss": "cat"}
    got = {r["token"]: r["lemma"] for r in dictionary_lemmas(frame, dictionary, odd).collect()}
    assert got["geese"] == "geese" and "men" not in got  # equal lengths go by the form; an exception the dictionary lacks
    texts = spark.createDataFrame([(1, "the cats as men"), (2, ""), (3, None)], "id int, c string")
    out = lemmatize_with_dictionary(texts, "id", F.split("c", " "), dictionary, "p", odd)
    assert {r["id"]: r["p"] for r in out.collect()} == {1: "the cat a men", 2: "", 3: ""}
    assert dictionary_lemmas(frame, dictionary.limit(0)).count() == 0


def test_tokens_of_a_broadcast_lemma_table_are_not_shuffled(spark):
    from threadtide.operators.lemmas import lemmatize_with_table

    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c")], "id int, t string")
    lemmas = spark.createDataFrame([("a", "x")], "token string, lemma string")
    out = lemmatize_with_table(rows, "id", F.split("t", " "), lemmas, "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id#") == plan.count("REPARTITION_BY_COL") > 0
    assert {r.id: r.p for r in out.collect()} == {1: "b x b", 2: "", 3: "c"}


def test_terms_of_a_large_table_that_occur_are_looked_up_in_the_row(spark, monkeypatch):
    from threadtide.functions import lexicon

    texts = spark.createDataFrame([("great not great thing", 1), ("", 2), (None, 3), ("awful very great", 4), ("filler7 x", 5)], "body string, id int")
    filler = spark.range(60_000).select(F.concat(F.lit("filler"), "id").alias("term"), F.lit(1.0).alias("valence"))
    terms = spark.createDataFrame([("great", 3.0), ("great", 1.0), ("awful", -2.0), ("very", 9.0), ("thing", None)], "term string, valence double").unionAll(filler)
    made = lexicon.add_sentiment_with_table(texts, "id", "body", terms)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.columns[:2] == ["id", "body"] and "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(lexicon, "MAX_TERMS", 1)
    joined = lexicon.add_sentiment_with_table(texts, "id", "body", terms)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, joined.collect()))
