"""English word stems by the published Snowball English algorithm (Porter2), and the stop words that go with it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that an English text index leaves out.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# Words whose stem no rule gives, and words that stay as they are from the start or after the first step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings of the second, third and fourth step, with what stands in their place.
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

VOWELS = "aeiouy"
#: The part after the first consonant that follows a vowel.
_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_AHEAD = re.compile("gener|commun|arsen")
_HAS_VOWEL = re.compile(f"[{VOWELS}]")
#: A short syllable at the end: vowel and consonant at the beginning, or consonant, vowel and a consonant other than w, x and Y.
_SHORT = re.compile(f"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions R1 and R2 begin."""
    ahead = _AHEAD.match(word)
    found = ahead or _REGION.search(word)
    first = found.end() if found else len(word)
    again = _REGION.search(word, first)
    return first, again.end() if again else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and _HAS_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    if word.endswith(("eed", "eedly")):
        ending = "eedly" if word.endswith("eedly") else "eed"
        return word[: len(word) - len(ending)] + "ee" if len(word) - len(ending) >= first else word
    ending = _longest(word, ("ed", "edly", "ing", "ingly"))
    if ending is None or not _HAS_VOWEL.search(word[: -len(ending)]):
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(_DOUBLE):
        return word[:-1]
    return word + "e" if len(word) <= first and _SHORT.search(word) else word


def _derived(word: str, first: int, second: int) -> str:
    ending = _longest(word, (*SECOND, "ogi", "li"))
    if ending and len(word) - len(ending) >= first:
        body = word[: -len(ending)]
        if ending in SECOND:
            word = body + SECOND[ending]
        elif (ending == "ogi" and body.endswith("l")) or (ending == "li" and body[-1:] and body[-1] in "cdeghkmnrt"):
            word = word[:-1] if ending == "ogi" else body
    ending = _longest(word, (*THIRD, "ative"))
    if ending and len(word) - len(ending) >= first:
        body = word[: -len(ending)]
        if ending != "ative":
            word = body + THIRD[ending]
        elif len(body) >= second:
            word = body
    ending = _longest(word, (*FOURTH, "ion"))
    if ending and len(word) - len(ending) >= second and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters, and words with letters other than a to z, which the rules don't know, stay."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in UNCHANGED or not word.isascii():
        return word
    word = re.sub(f"(^|[{VOWELS}])y", r"\1Y", word)  # a y that is a consonant
    first, second = _regions(word)
    word = _plural(word)
    if word in UNCHANGED_AFTER_PLURAL:
        return word.lower()
    word = _past(word, first)
    if word[-1:] in ("y", "Y") and len(word) > 2 and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, first, second)
    if word.endswith("e"):
        if len(word) - 1 >= second or (len(word) - 1 >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def english_stem(term: Column) -> Column:
    """stem() of a column, in Arrow batches; null stays null."""

    @F.arrow_udf("string")
    def run(terms: pa.Array) -> pa.Array:
        coded = terms.dictionary_encode()
        return pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return run(term)
