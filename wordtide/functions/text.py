"""Cleaning and tokenising of short texts, as column expressions over arrays of tokens.

All steps but stemming are built-in expressions. A null text gives a null, an empty one the array [""].
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicons
from .stemmer import stem

POSITIVE = r"^[:;=].*\)$|^\(.*[:;=]$"
NEGATIVE = r"^[:;=].*\($|^\).*[:;=]$"
SMILE = r"^(haha|\*g)|^(lol|:d|;d|=d)$"
LOVE = r"^&lt;.*3$|^<3+$"

#: (pattern, replacement) that shorten lengthened vowels; o and e may stand twice.
SQUEEZE = (("aa+", "a"), ("uu+", "u"), ("ii+", "i"), ("ooo+", "o"), ("eee+", "e"))


def split_words(text: Column) -> Column:
    """Lower-case tokens between single spaces; trailing empty ones are dropped."""
    return F.split(F.lower(F.rtrim(text)), " ")


def emoticon(token: Column) -> Column:
    """A word for an emoticon, laughter or a heart; another token stays."""
    return F.when(token.rlike(POSITIVE), "positive").when(token.rlike(NEGATIVE), "negative").when(token.rlike(SMILE), "smile").when(token.rlike(LOVE), "love").otherwise(token)


def emoticons(words: Column) -> Column:
    return F.transform(words, emoticon)


def _in(token: Column, words: Sequence[str]) -> Column:
    return F.coalesce(token.isin(*words), F.lit(False))


def _map(of: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def is_negation(token: Column) -> Column:
    return F.coalesce(token.endswith("n't") | token.endswith("not") | token.isin("nor", "neither"), F.lit(False))


def negations(words: Column, verbs: Sequence[str] = lexicons.VERBS, antonyms: Mapping[str, str] = lexicons.ANTONYMS, fillers: Sequence[str] = lexicons.FILLERS) -> Column:
    """Resolve negations with the one or two tokens after them.

    With a verb they become ``NOT`` and the verb; with a word that has an opposite the opposite; a
    filler between them is dropped in any case. A token is never used up by two negations, for
    no negation is a verb, an opposite or a filler, so each token is decided from its neighbours.
    """
    opposite = _map(antonyms)
    listed = tuple(antonyms)
    none = F.lit(None).cast("string")
    far = F.lit(1 << 30)
    # a token with the two before it and the two after it; the last two rows have no token
    around = F.arrays_zip(F.slice(words, 1, far), F.concat(F.array(none), words), F.concat(F.array(none, none), words), F.slice(words, 2, far), F.slice(words, 3, far))
    field = {0: "0", -1: "1", -2: "2", 1: "3", 2: "4"}

    def one(z: Column) -> Column:
        at = lambda k: z.getField(field[k])
        t = at(0)
        untouched = ~(is_negation(t) | is_negation(at(-1)) | is_negation(at(-2)))
        plain = F.when(at(1).isNotNull(), F.replace(t, F.lit("n't"), F.lit("not"))).otherwise(t)
        verb, filler, other = (lambda k: _in(at(k), verbs)), (lambda k: _in(at(k), fillers)), (lambda k: _in(at(k), listed))
        skips = lambda k: filler(k) & at(k + 1).isNotNull()
        negated = (
            F.when(verb(1), F.concat(F.lit("NOT"), at(1)))
            .when(skips(1), F.when(other(2), F.try_element_at(opposite, at(2))).otherwise(plain))
            .when(other(1), F.try_element_at(opposite, at(1)))
            .otherwise(plain)
        )
        after = is_negation(at(-1)) & ~is_negation(t)
        return (
            F.when(untouched, t)
            .when(is_negation(t), negated)
            .when(after & (verb(0) | skips(0) | other(0)), none)
            .when(is_negation(at(-2)) & ~verb(-1) & filler(-1) & ~is_negation(t) & other(0), none)
            .otherwise(t)
        )

    return F.filter(F.transform(around, one), lambda t: t.isNotNull())


def squeeze(token: Column) -> Column:
    """Shorten lengthened vowels."""
    for pattern, short in SQUEEZE:
        token = F.regexp_replace(token, pattern, short)
    return token


def colloquial(words: Column, terms: Mapping[str, str] = lexicons.COLLOQUIAL) -> Column:
    """Replace colloquial tokens by their words, which may be several."""
    known = _map(terms)
    return F.flatten(F.transform(words, lambda t: F.split(F.coalesce(F.try_element_at(known, t), t), " ")))


def unmark(words: Column) -> Column:
    """Without mentions and links; hashtags lose their mark."""
    kept = F.filter(words, lambda t: ~t.rlike("^(@|http)"))
    return F.transform(kept, lambda t: F.regexp_replace(t, "^#", ""))


def letters(token: Column) -> Column:
    """Only the letters a to z, of either case."""
    return F.regexp_replace(token, "[^a-zA-Z]", "")


def without_stop_words(words: Column, stop: Sequence[str] = lexicons.STOP_WORDS) -> Column:
    """Without stop words and empty tokens."""
    return F.filter(words, lambda t: ~t.isin("", *stop))


def rejoin(words: Column) -> Column:
    return F.array_join(words, " ")


#: Texts that may hold a token which a step changes; the others pass it as they are.
_MARKED = r"(?:^| )(?:[:;=()@#*]|http|haha|lol|&lt;|<3)"
_NEGATED = r"(?:n't|not)(?: |$)|(?:^| )(?:nor|neither)(?: |$)"


def _where(text: Column, guard: str, step: Callable[[Column], Column]) -> Column:
    """The text with a step of the chain done on its words, if the guard finds that it may change any."""
    return F.when(text.rlike(guard), rejoin(step(F.split(text, " ")))).otherwise(text)


def clean(text: Column, verbs: Sequence[str] = lexicons.VERBS, antonyms: Mapping[str, str] = lexicons.ANTONYMS, terms: Mapping[str, str] = lexicons.COLLOQUIAL) -> Column:
    """The whole chain but stemming: a cleaned text.

    What a step does to each word alone is done on the whole text at once where no pattern
    reaches over a space; steps on single words run only where a text may hold one of them.
    """
    text = F.lower(F.rtrim(text))
    text = _where(text, _MARKED, lambda words: unmark(emoticons(words)))
    text = squeeze(_where(text, _NEGATED, lambda words: negations(words, verbs, antonyms)))
    if terms:
        text = _where(text, "(?:^| )(?:" + "|".join(map(re.escape, terms)) + ")(?: |$)", lambda words: colloquial(words, terms))
    text = F.regexp_replace(text, "[^a-zA-Z ]+", "")
    return rejoin(without_stop_words(F.split(text, " ")))


@F.pandas_udf(StringType())
def stemmed(text: pd.Series) -> pd.Series:
    """Every word of a text by its stem; a worker stems a word once."""
    return text.map(lambda t: None if t is None else " ".join(map(stem, t.split(" "))))
