"""Keyword sets for the last tier of matching.

``lemma_keywords`` uses a lemmatiser with part-of-speech tags if one is installed.
``token_keywords`` is an approximation of it without lemmas or tags: lower-case word tokens
over two characters, less stop words. The two don't agree in general.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgauge.functions.text import WORD

STOP = ("aan", "als", "bij", "dan", "dat", "de", "den", "der", "des", "die", "dit", "een", "en", "er", "het", "hij", "ik", "in", "is", "met", "naar", "niet", "of", "om", "onder", "op", "over", "te", "tot", "uit", "van", "voor", "wel", "wordt", "zijn", "the", "and", "for", "with", "from", "are", "was", "not")
KINDS = ("NOUN", "VERB", "ADJ")


def token_keywords(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[{WORD}]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


@functools.cache
def _tagger(model: str):
    import spacy

    return spacy.load(model)


def lemma_keywords(text: Column, model: str = "nl_core_news_sm") -> Column:
    """Lower-case lemmas over two characters of nouns, verbs and adjectives that aren't stop words."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        docs = _tagger(model).pipe(t or "" for t in texts)
        return pd.Series([sorted({w.lemma_.lower() for w in d if w.pos_ in KINDS and not w.is_stop and len(w.lemma_) > 2}) for d in docs])

    return run(text)
