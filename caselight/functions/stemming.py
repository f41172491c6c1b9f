"""English stems by suffix rules (Porter's, with the extensions that scorers of summaries use).

The rules are tables; one function takes the first suffix of a table that a word ends with. A batch's
distinct words are stemmed once each, and the words of its rows point to them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Suffixes with what replaces them, in the order in which they are tried; for the second table
# the condition is a positive measure of what stands before, for the fourth a measure above one.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
REPAIRS = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Words of up to so many characters have no other stem than themselves, in scores of summaries.
SHORT = 3


def shape(word: str) -> str:
    """``c`` or ``v`` for each character; a y behind a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x, y; or vowel and consonant alone."""
    s = shape(word)
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or s == "vc"


def _first(word: str, rules: tuple[tuple[str, str], ...], holds: Callable[[str, str], bool]) -> str:
    for suffix, other in rules:
        if word.endswith(suffix):
            start = word[: len(word) - len(suffix)]
            return start + other if holds(start, suffix) else word
    return word


def _positive(start: str, _: str) -> bool:
    return measure(start) > 0


def _past(word: str) -> str:
    """Without -ed and -ing, repaired."""
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        start = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in shape(start):
            for end, other in REPAIRS:
                if start.endswith(end):
                    return start[: -len(end)] + other
            if shape(start)[-2:] == "cc" and start[-1] == start[-2]:
                return start if start[-1] in "lsz" else start[:-1]
            return start + "e" if measure(start) == 1 and _short_end(start) else start
    return word


def _second(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _second(word[:-2])
    out = _first(word, SECOND, _positive)
    if out == word and word.endswith("logi") and measure(word[:-3]) > 0 and not any(word.endswith(s) for s, _ in SECOND):
        return word[:-1]
    return out


def _fourth(start: str, suffix: str) -> bool:
    return measure(start) > 1 and (suffix != "ion" or start[-1] in "st")


def stem(word: str) -> str:
    """Of a word in lower case."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _first(word, PLURALS, lambda *_: True)
    word = _past(word)
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _first(_second(word), THIRD, _positive)
    word = _first(word, tuple((s, "") for s in FOURTH), _fourth)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


_WORD = re.compile("[a-z0-9]+")


def _stemmed(column: pa.Array) -> pa.Array:
    lists = [[] if x is None else _WORD.findall(x.lower()) for x in column.to_pylist()]
    flat = pa.array([w for words in lists for w in words], pa.string()).dictionary_encode()
    stems = pa.array([w if len(w) <= SHORT else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    offsets = [0]
    for words in lists:
        offsets.append(offsets[-1] + len(words))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.take(stems, flat.indices))


def stems(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with an array of stems, under its new name, for each text column of ``columns``: runs of a-z
    and digits in lower case, longer ones than ``SHORT`` as their stems. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_stemmed(b.column(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *columns.values()])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, ArrayType(StringType())) for n in columns.values()]]))
