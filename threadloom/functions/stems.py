"""Index terms: lower case, no diacritics, split at what is neither letter nor digit, stemmed by Porter's algorithm (1980)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\W_]+")
#: Characters of the texts that a worker holds split at a time, and stems that it remembers.
GROUP, KEPT = 1 << 18, 20_000


def fold(text: str) -> str:
    """Lower case without combining marks; letters that don't decompose (as the sharp s) stay."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _ends_double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=KEPT)
def stem(word: str) -> str:
    """Bytes count as letters, as in the index that this one matches; those outside ASCII are consonants."""
    raw = word.encode()
    return word if len(raw) < 3 or len(raw) > 64 else _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def _stem(w: str) -> str:
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _ends_double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _ends_cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def terms(text: str | None) -> list[str]:
    return [stem(w) for w in _WORD.findall(fold(text or ""))]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a column of texts, in groups of about GROUP characters."""
    start, size, group = 0, 0, []
    for i in range(len(column)):
        group.append(column[i].as_py() or "")
        size += len(group[-1])
        if size >= GROUP:
            yield start, group
            start, size, group = i + 1, 0, []
    if group:
        yield start, group


def _per_group(rows: DataFrame, id_col: str, text_col: str, of_text, name: str, kind: pa.DataType, type_name: str) -> DataFrame:
    """(id, name): of_text of each text. A worker holds one group of texts at a time, however many rows its batches have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(map(of_text, texts), kind, size=len(texts))], names=[id_col, name])
        pa.default_memory_pool().release_unused()

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {name} {type_name}")


def stemmed_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): terms() of each row's text."""
    return _per_group(rows, id_col, text_col, terms, "tokens", pa.list_(pa.string()), "array<string>")


def stemmed_lengths(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl): how many terms each row's text has; none is stemmed for that."""
    return _per_group(rows, id_col, text_col, lambda t: len(_WORD.findall(fold(t))), "dl", pa.int32(), "int")
