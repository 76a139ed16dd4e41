"""Scalar functions over texts and tokens, exact in Unicode: plain functions of one value, and the same over Arrow batches.

A text's own offsets are code points; those of suggestions are UTF-16 units, as browsers count them (`utf16`, `points`).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' patterns see it, and a word boundary of ASCII words.
SPACE = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Tokens of the edit language, and whole words for spelling.
TOKEN = regex.compile(r"\p{L}+(?:['’]\p{L}+)*|[0-9]+|[^\p{L}\p{N}_\s]")
WHOLE = regex.compile(r"[\p{L}\p{M}\p{N}\p{Pc}‌‍]+(?:['’‐‑-][\p{L}\p{M}\p{N}\p{Pc}‌‍]+)*")
_CONTRACTION = regex.compile(r"\b([A-Za-z]+)\s+(n['’]t|['’](?:s|m|d|ll|re|ve))\b", regex.I)
_BEFORE = {1: regex.compile(r"\s+([.,!?;:])"), 2: regex.compile(r"\s+([.,!?;:)\]}])")}
_AFTER = regex.compile(r"([(\[{])\s+")
#: Numerals that count as numbers in a lexical family.
NUMERALS = frozenset("zero one two three four five six seven eight nine ten".split())
#: What a suffix operation takes from the end of a word and puts there.
SUFFIXES = {"ADD_S": ("", "s"), "REMOVE_S": ("s", ""), "ADD_ES": ("", "es"), "REMOVE_ES": ("es", ""), "Y_TO_IES": ("y", "ies"), "IES_TO_Y": ("ies", "y")}


def normalized(text: str) -> str:
    """NFC, with runs of white space as one blank."""
    return " ".join(unicodedata.normalize("NFC", text).split())


def key(text: str) -> str:
    """C2."""
    return normalized(text).casefold()


def tokenize(text: str) -> list[str]:
    """C5."""
    return TOKEN.findall(text)


def render(words: list[str], schema: int = 1) -> str:
    """Tokens as text, marks attached; from schema 2 on brackets too."""
    text = _BEFORE[schema].sub(r"\1", " ".join(words))
    return _AFTER.sub(r"\1", text) if schema == 2 else text


def canonical(text: str) -> str:
    """Split contractions joined, then rendered anew."""
    return render(tokenize(_CONTRACTION.sub(r"\1\2", text)), 2)


def keys(text: str) -> list[str]:
    """The keys by which a text is held out: of itself and of its canonical form (C4)."""
    return sorted({key(text), key(canonical(text))})


def utf16(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


def points(text: str, units: int) -> int:
    """Code points before a UTF-16 offset."""
    if text.isascii():
        return units
    return len(text.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "replace"))


def split_words(text: str) -> list[tuple[str, int, int]]:
    """Tokens with their UTF-16 spans."""
    out, at, units = [], 0, 0
    for m in TOKEN.finditer(text):
        units += utf16(text[at : m.start()])
        at, end = m.end(), units + utf16(m.group())
        out.append((m.group(), units, end))
        units = end
    return out


def spelling_words(text: str) -> list[tuple[str, int, int]]:
    """Whole Unicode words, compounds and contractions in one piece, with their spans in code points."""
    return [(m.group(), m.start(), m.end()) for m in WHOLE.finditer(text)]


def preserve_case(original: str, replacement: str) -> str:
    """C9."""
    if len(original) > 1 and original == original.upper():
        return replacement.upper()
    return replacement[:1].upper() + replacement[1:] if "A" <= original[:1] <= "Z" else replacement


def suffixed(word: str, operation: str) -> str | None:
    """A suffix operation on an ASCII word, None where it can't be done."""
    if operation not in SUFFIXES or not (word.isascii() and word.isalpha()):
        return None
    old, new = SUFFIXES[operation]
    stem = word.lower().removesuffix(old)
    done = word.lower().endswith(old) and stem
    return preserve_case(word, stem + new) if done else None


def delete_keys(word: str, depth: int, prefix: int = 7) -> list[str]:
    """The word's prefix and what is left of it after up to `depth` deletions."""
    level = every = {word[:prefix]}
    for _ in range(depth):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        every = every | level
    return sorted(every)


def lexical_family(text: str) -> str:
    """Hash of a text's words without case, marks and numbers (C20)."""
    words = [t.casefold().replace("’", "'") for t in tokenize(normalized(text)) if any(map(str.isalnum, t))]
    return sha256("\0".join("#" if w.isdigit() or w in NUMERALS else w for w in words).encode()).hexdigest()


#: Ranges of code points that BERT's tokenizer sets apart.
CHINESE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def is_chinese(character: str) -> bool:
    """C22."""
    return any(a <= ord(character) <= b for a, b in CHINESE)


def word_pieces(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[int]:
    """Greedy longest pieces of a word without case and accents; what can't be pieced is the unknown one."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
    plain = "".join(f" {c} " if is_chinese(c) else c for c in plain)
    ids: list[int] = []
    for part in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", plain):
        at, found = 0, []
        while at < len(part) <= longest:
            end = next((e for e in range(len(part), at, -1) if ("##" if at else "") + part[at:e] in vocabulary), 0)
            if not end:
                break
            found.append(vocabulary[("##" if at else "") + part[at:end]])
            at = end
        ids += found if at == len(part) else [vocabulary[unknown]]
    return ids or [vocabulary[unknown]]


def chunks(text: str, sizes: Callable[[str], int], most: int) -> list[list[tuple[str, int, int]]]:
    """Tokens packed into windows of `most` pieces with two marks; a sentence's end closes one, a token too long for any is left out."""
    if not 4 <= most <= 512:
        raise ValueError("a window has 4 to 512 pieces")
    out: list[list] = [[]]
    room = most - 2
    for token in split_words(text):
        n = sizes(token[0])
        if n > room or n > most - 2:
            out.append([])
            room = most - 2
        if n <= most - 2:
            out[-1].append(token)
            room -= n
        if token[0] in (".", "!", "?") and n <= most - 2:
            out.append([])
            room = most - 2
    return [x for x in out if x]


def over_arrow(run: Callable, kind: str) -> Callable[..., Column]:
    """run as a column function over Arrow batches; null where an argument is null."""

    def each(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else run(*row) for row in zip(*columns, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return each(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return each(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return each(a, b, c)

    return lambda *columns: F.pandas_udf((one, two, three)[len(columns) - 1], kind)(*columns)
