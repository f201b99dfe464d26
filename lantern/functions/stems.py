"""Stems of Spanish words by the published Snowball rules: a small helper for single words, applied in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The endings of the rules.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir", "ando": "ando", "iendo": "iendo", "ar": "ar", "er": "er", "ir": "ir", "yendo": "yendo"}
PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ADORA = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
SHORT_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
PLAIN_VOWELS = str.maketrans("áéíóú", "aeiou")


def _after(word: str, begin: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(begin + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _by_length(endings) -> tuple[frozenset[str], int]:
    return frozenset(endings), max(map(len, endings))


def _longest(word: str, endings: tuple[frozenset[str], int]) -> str | None:
    known, most = endings
    for n in range(min(most, len(word)), 0, -1):
        if (e := word[-n:]) in known:
            return e
    return None


_KIND = {e: "plain" for e in PLAIN} | {e: "adora" for e in ADORA} | {e: "idad" for e in ("idad", "idades")} | {e: "iva" for e in ("iva", "ivo", "ivas", "ivos")}
_PRONOUNS, _BEFORE, _LAST = _by_length(PRONOUNS), _by_length(BEFORE_PRONOUN), _by_length(["os", "a", "o", "á", "í", "ó", "e", "é"])
_SUFFIXES, _Y, _VERBS = _by_length([*_KIND, *REPLACED, "amente", "mente"]), _by_length(Y_VERBS), _by_length([*SHORT_VERBS, *VERBS])
_MORE = {k: _by_length(v) for k, v in {"amente": ["ativ", "iv", "os", "ic", "ad"], "mente": ["ante", "able", "ible"], "plain": [""], "adora": ["ic"], "idad": ["abil", "ic", "iv"], "iva": ["at"]}.items()}


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a small-letter word."""
    rv, r1 = _rv(word), _after(word, 0)
    r2 = _after(word, r1)
    pronoun = _longest(word, _PRONOUNS)
    if pronoun:
        rest = word[: -len(pronoun)]
        before = _longest(rest, _BEFORE)
        if before and len(rest) - len(before) >= rv and (before != "yendo" or rest[:-5].endswith("u")):
            word = rest[: -len(before)] + BEFORE_PRONOUN[before]
    begun = word
    word = _suffix(word, r1, r2)
    if word == begun:
        word = _verb(word, rv)
    last = _longest(word, _LAST)
    if last and len(word) - len(last) >= rv:
        word = word[: -len(last)]
        if last in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(PLAIN_VOWELS)


def _suffix(word: str, r1: int, r2: int) -> str:
    found = _longest(word, _SUFFIXES)
    if not found:
        return word
    at = len(word) - len(found)
    if found == "amente":
        if at < r1:
            return word
        word = word[:at]
        cut = _longest(word, _MORE["amente"])
        if cut == "ativ" and len(word) - 4 < r2:
            cut = "iv"
        return word[: -len(cut)] if cut and len(word) - len(cut) >= r2 else word
    if at < r2:
        return word
    if found in REPLACED:
        return word[:at] + REPLACED[found]
    word = word[:at]
    cut = _longest(word, _MORE["mente" if found == "mente" else _KIND[found]])
    return word[: -len(cut)] if cut and len(word) - len(cut) >= r2 else word


def _verb(word: str, rv: int) -> str:
    y = _longest(word[rv:], _Y)
    if y and word[: -len(y)].endswith("u"):
        return word[: -len(y)]
    found = _longest(word[rv:], _VERBS)
    if not found:
        return word
    word = word[: -len(found)]
    return word[:-1] if found in SHORT_VERBS and word.endswith("gu") else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of arrays of words."""
    return words.map(lambda a: None if a is None else [stem(w) for w in a])
