"""Text functions of the link scorer, as native expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from .vectorised import vectorised

#: Words that carry no topic.
STOPWORDS = tuple(
    """
    a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from
    further get got had has have having he her here hers herself him himself his how i if in into is it its itself just let me more most my myself no nor not now of off on once only or other
    our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were
    what when where which while who whom why will with would you your yours yourself yourselves us via per may might must shall use using used new one two three best top guide page home
    www com html htm php aspx index
    """.split()
)
#: Stemmed business words that describe almost every page.
GENERIC_TERMS = tuple(
    """
    development develop developer software solution company service technology tech business custom digital enterprise agency provider expert professional product system platform application app
    online team client customer work process industry leading trusted affordable cost price quality support offer help learn get build create make need way year
    """.split()
)
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse(text: Column) -> Column:
    """Runs of any white space as one space, none at the edges."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stem(token: Column) -> Column:
    """Plural endings off: ``ies`` to ``y`` from five letters, ``s`` from four, never ``ss``."""
    n = F.char_length(token)
    return (
        F.when(token.endswith("ies") & (n >= 5), F.concat(F.substr(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("s") & (n >= 4) & ~token.endswith("ss"), F.substr(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def tokenize(text: Column) -> Column:
    """Stemmed words of two characters and more, without stop-words and numbers; null gives no words."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    plain = F.transform(raw, lambda t: F.translate(t, "’", "'"))
    kept = F.filter(plain, lambda t: (F.char_length(t) >= 2) & ~t.isin(*STOPWORDS) & ~t.rlike(r"^[\p{Nd}²³¹]+$"))
    return F.transform(kept, stem)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` reads it; array functions share no subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(tokens: Column, n: int) -> Column:
    out, left = tokens, F.size(tokens)
    for k in range(1, n):
        shorter = F.greatest(left - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), shorter), F.slice(tokens, F.lit(k + 1), shorter), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces."""
    return _once(tokens, lambda t: _runs(t, n))


def terms(tokens: Column) -> Column:
    return _once(tokens, lambda t: F.concat(t, _runs(t, 2)))


def phrases(tokens: Column) -> Column:
    """Runs of two and of three tokens."""
    return _once(tokens, lambda t: F.concat(_runs(t, 2), _runs(t, 3)))


def keyword_text(keywords: Column) -> Column:
    return F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " ; ")


def is_generic(term: Column) -> Column:
    return F.forall(F.split(term, " "), lambda t: t.isin(*GENERIC_TERMS))


def translate_quotes(text: Column) -> Column:
    return F.translate(text, "’‘“”", "''\"\"")


@vectorised("string")
def casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def matchable(text: Column) -> Column:
    """Form in which texts are compared: straight quotes, single spaces, folded case."""
    plain = collapse(translate_quotes(text))
    return F.when(plain.rlike(r"[^\x00-\x7f]"), casefold(plain)).otherwise(F.lower(plain))


def sentences(block: Column) -> Column:
    """Sentences of at most 400 characters and at least five words."""
    parts = F.split(block, r"(?<=[.!?])\s+(?=[\"“'‘(]?[\p{Lu}\p{N}])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (F.char_length(s) <= 400) & (F.size(F.regexp_extract_all(s, F.lit(WORD), F.lit(0))) >= 5))


def split_lines(text: Column) -> Column:
    """Lines by any line break, CR LF as one; a break at the end opens no line, and no text has none."""
    lines = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    whole = _once(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def mention_credit(count: Column) -> Column:
    return F.when(count > 0, 1 - F.exp(-count / 2.0)).otherwise(0.0)


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space, with an ellipsis."""
    head = F.substr(text, F.lit(1), F.lit(limit))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r"\s+\S*$", "")), F.lit("…")))


def fold_char(char: str) -> str:
    """One character as ``matchable`` has it, for offset maps."""
    return {"’": "'", "‘": "'", "“": '"', "”": '"'}.get(char, char).casefold()


def is_word(char: str) -> bool:
    return char.isalnum() and unicodedata.category(char)[0] in "LN"
