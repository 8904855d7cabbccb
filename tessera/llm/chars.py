"""Character tables built by rule from the Unicode database, and a fold of whole batches of text by them."""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose printed shape equals that of a Latin letter.
LOOK_ALIKE = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ғ": "F",
    # Greek, small and capital
    "ο": "o", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian and other scripts
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "Լ": "L", "ɑ": "a", "ɡ": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z",
}

# Dashes printed like the hyphen, marks printed like simpler ones, radicals printed like ideographs.
LOOK_ALIKE_SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "⁃": "-", "˗": "-", "➖": "-", "∶": ":", "꞉": ":", "⁄": "/", "∕": "/",
    "‚": ",", "․": ".", "ʼ": "'", "ʹ": "'", "′": "'", "∙": "·", "‧": "·", "・": "·",
    "⺝": "月", "⺟": "母", "⺠": "民", "⺮": "竹", "⺼": "月", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长",
    "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼",
    "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟",
}

#: Compatibility mappings that change the printed shape (raised, lowered, circled, fractions) stay as they are.
VISIBLE_TAGS = {"<super>", "<sub>", "<circle>", "<fraction>"}
HIDDEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0xE0100, 0xE01F0))


def hidden(ch: str) -> bool:
    """Characters that print nothing at all."""
    return ord(ch) in HIDDEN or ud.category(ch) == "Cf" or (ud.category(ch) == "Cc" and not ch.isspace())


@cache
def printed(ch: str) -> str:
    """What ``ch`` prints as: nothing, itself, or its decomposition with look-alikes replaced."""
    if hidden(ch):
        return ""
    if ud.category(ch) == "Zs":
        return " "
    if (x := LOOK_ALIKE.get(ch) or LOOK_ALIKE_SIGNS.get(ch)) is not None:
        return x
    parts = ud.decomposition(ch).split()
    if not parts or parts[0] in VISIBLE_TAGS:
        return ch
    return "".join(printed(chr(int(p, 16))) for p in parts if not p.startswith("<"))


def planes() -> range:
    return range(0x1FC00)


@cache
def printed_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, [(replacement code point, its combining class)]) for each code point that is replaced or combines.

    Hangul vowels and finals, of class 0, are given as 1: they too call for recomposing.
    """
    rows = []
    for cp in [*planes(), *range(0x2F800, 0x2FA1E), *range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)]:
        if 0xD800 <= cp <= 0xF8FF and not (0xF900 <= cp):
            continue  # surrogates and private use
        ch = chr(cp)
        out = printed(ch)
        joins = 0x1161 <= cp <= 0x1175 or 0x11A8 <= cp <= 0x11C2  # vowels and finals of Hangul make syllables with what is before them
        if out != ch or ud.combining(ch) or joins:
            rows.append((ch, [(c, ud.combining(c) or int(joins)) for c in out]))
    return rows


@cache
def fixed_class() -> str:
    """A character class of code points that are their own printed form and combine with nothing before them."""
    active = {ord(r[0]) for r in printed_rows()}
    out, start = [], None
    for cp in range(0x20, 0x30000):
        ok = cp not in active and not 0xD800 <= cp <= 0xF8FF
        if ok and start is None:
            start = cp
        if not ok and start is not None:
            if cp - start >= 64:
                out.append((start, cp - 1))
            start = None
    out.append((start, 0x2FFFF))
    return "\\n\\r\\t" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def needs_form(text: Column) -> Column:
    """True where a text may differ from its printed form; texts of plain characters are their own form."""
    return text.rlike(f"[^{fixed_class()}]")


#: Blocks of ideographs and kana, each sign of which is a word of its own.
IDEOGRAPHS = ((0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))
#: Code points that stand for themselves without a look: ideographs, Hangul, surrogates and private use.
_PLAIN = ((0x3400, 0x9FFF), (0xAC00, 0xF8FF), (0x20000, 0x2F7FF))


def is_ideograph(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), bool)
    for a, b in IDEOGRAPHS:
        out |= (codes >= a) & (codes <= b)
    return out


def folded(ch: str) -> str:
    """What ``ch`` counts as when texts are compared: its printed form in lower case without accents; signs that only join or mark count as nothing."""
    if hidden(ch) or ud.combining(ch):
        return ""
    low = ch.lower()
    if len(low) > 1:
        low = "".join(c for c in low if not ud.combining(c))
    flat = "".join(c for x in low for c in ud.normalize("NFKD", printed(x)) if not ud.combining(c)).lower()
    flat = "".join(LOOK_ALIKE.get(c, c) for c in flat).replace("ς", "σ")
    several = len(flat) > 1 and not (flat.isascii() and flat.isalpha() and not 0x2100 <= ord(ch) < 0x2150 and not 0x3200 <= ord(ch) < 0xFB00)
    return low if several else flat


class Folding(NamedTuple):
    """For each code point: what it folds to (0: nothing; from ``LAST`` on: a row of ``several``), and its kind: 1 letter or digit, 2 ideograph, 0 else."""

    to: np.ndarray
    kind: np.ndarray
    several: list[np.ndarray]


LAST = 0x110000


@cache
def folding() -> Folding:
    """The tables, some 5 MB, made once in each process."""
    to, kind, several = np.arange(LAST, dtype=np.uint32), np.zeros(LAST, np.uint8), []
    for cp in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        plain = any(a <= cp <= b for a, b in _PLAIN)
        if plain and not 0xF900 <= cp:
            kind[cp] = not 0xD800 <= cp <= 0xF8FF
            continue
        ch, category = chr(cp), ud.category(chr(cp))
        kind[cp] = category[0] in "LN"
        if category[0] not in "CMZ" and ch.lower() == ch and not ud.decomposition(ch) and ch not in LOOK_ALIKE and ch not in LOOK_ALIKE_SIGNS and cp not in HIDDEN and ch != "ς":
            continue
        flat = folded(ch)
        if flat == "":
            to[cp] = 0
        elif len(flat) == 1:
            to[cp] = ord(flat)
        else:
            to[cp] = LAST + len(several)
            several.append(np.array([ord(c) for c in flat], np.uint32))
    for a, b in IDEOGRAPHS:
        kind[a : b + 1] *= 2
    return Folding(to, kind, several)


class Letters(NamedTuple):
    """The folded letters and digits of several texts in a row; each has the number of its text and of its word, each word its hash and text."""

    codes: np.ndarray
    text: np.ndarray
    word: np.ndarray
    hashes: np.ndarray
    word_text: np.ndarray


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values scrambled, the same in every process."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fold_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts, each followed by a line end; the number of the text of each)."""
    fold_ = folding()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    to = fold_.to[raw]
    if len(fold_.several) and to.max(initial=0) >= LAST:
        many = to >= LAST
        size = np.ones(len(to), np.int64)
        size[many] = [len(fold_.several[i - LAST]) for i in to[many]]
        at = np.cumsum(size) - size
        wide = np.repeat(to, size)
        for i, v in zip(at[many], to[many], strict=True):
            wide[i : i + len(fold_.several[v - LAST])] = fold_.several[v - LAST]
        to, text = wide, np.repeat(text, size)
    keep = to > 0
    return to[keep], text[keep]


def letters(texts: list[str], together: bool = False) -> Letters:
    """The folded letters of ``texts`` by words: runs of letters and digits, and single ideographs.

    With ``together`` signs and white space part words only where white space stands: ``don't`` is one word.
    """
    codes, text = fold_codes(texts)
    kind = folding().kind[codes]
    if together:
        apart = (kind > 0) | (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0x85) | (codes == 0xA0)
        codes, text, kind = codes[apart], text[apart], kind[apart]
    begins = kind == 2
    begins[0:1] |= kind[0:1] == 1
    begins[1:] |= (kind[1:] == 1) & (kind[:-1] != 1)
    own = kind > 0
    word = (np.cumsum(begins) - 1)[own]
    codes, text = codes[own], text[own]
    first = np.flatnonzero(begins[own])
    with np.errstate(over="ignore"):
        place = (np.arange(len(codes)) - first[word]).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        each = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
        hashes = mixed(np.add.reduceat(each, first)) if len(first) else np.zeros(0, np.uint64)
    return Letters(codes, text, word, hashes, text[first])


def slabs(texts: list[str], most: int = 200_000) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) in runs of about ``most`` characters, so that arrays stay small; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]
