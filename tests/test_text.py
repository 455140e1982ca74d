import pytest
from pyspark.sql import functions as F

from weftlink.functions import text as X
from weftlink.operators import anchors as N


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The AI Voice Agents and companies", ["ai", "voice", "agent", "company"]),
        ("Class glasses ties 2024 it's Don’t x", ["class", "glasse", "tie", "it'", "don't"]),
        ("état-major naïve Ünïcode", ["état-major", "naïve", "ünïcode"]),
        (None, []),
        ("", []),
    ],
)
def test_tokenize(spark, text, want):
    got = one(spark, text, X.tokenize)
    assert got == want == N.words_of(text) or got == N.words_of(text)


def test_ngrams(spark):
    grams = lambda n: lambda c: X.ngrams(F.split(c, " "), n)
    assert one(spark, "a b c d", grams(2)) == ["a b", "b c", "c d"]
    assert one(spark, "a b c d", grams(3)) == ["a b c", "b c d"]
    assert one(spark, "a", grams(2)) == [] and one(spark, "a b", grams(3)) == []


def test_sentences(spark):
    text = "This is the first sentence. Too short. And \"here\" comes one more with 3.5 numbers! lower case goes on after that? Yes it does so really."
    assert one(spark, text, X.sentences) == ["This is the first sentence.", "And \"here\" comes one more with 3.5 numbers! lower case goes on after that?", "Yes it does so really."]


def test_matchable(spark):
    assert one(spark, "  The “Straße”  x’s ", X.matchable) == 'the "strasse" x\'s'


CASES = [
    ("...", "x", "ANCHOR_EMPTY"),
    ("Click here!", "click here now", "ANCHOR_GENERIC"),
    ("of the", "of the best", "ANCHOR_NOT_DESCRIPTIVE"),
    ("voice agents voice", "voice agents voice", "ANCHOR_KEYWORD_STUFFING"),
    ("one1 two2 three3 four4 five5 six6 seven7 eight8 nine9", "x", "ANCHOR_TOO_LONG"),
    ("voice agents", "Our voice agentsx help", "ANCHOR_NOT_IN_CONTEXT"),
    ("Voice  Agents", "Our “voice agents” help", None),
    ("c++ (agents)", "use c++ (agents) now", None),
]


def test_anchor_problems(spark):
    rows = spark.createDataFrame(CASES, "a string, c string, want string")
    out = rows.select("a", "c", "want", N.anchor_problem(F.col("a"), F.col("c")).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out] == [N.problem_of(r["a"], r["c"]) for r in out]


def test_phrases_name_their_target():
    weights = N.Weights({"voice": 0.9, "agent": 0.8, "acme": 0.1}, {})
    found = [p["phrase"] for p in N.target_phrases("AI Voice Agents | Acme", None, ["voice agents for banks"], weights)]
    assert found[0] in ("voice agents for banks",) and "AI Voice Agents" in found
    assert not any(p.lower().endswith("for") or p == "Acme" for p in found)


def test_truncate(spark):
    assert one(spark, "alpha beta gamma", lambda c: X.truncated(c, 12)) == "alpha beta…"
    assert one(spark, "alpha", lambda c: X.truncated(c, 12)) == "alpha"


@pytest.mark.parametrize("text", [None, "", "a", "a\n", "a\r\nb", "\n", "a\n\nb\x0b\x0c c\u2028", "x\x85y\x1cz"])
def test_split_lines(spark, text):
    from weftlink.functions.text import split_lines

    got = spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t")).alias("x")).first()["x"]
    assert got == (text or "").splitlines()
