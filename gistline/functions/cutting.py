"""The text functions as plain Python: what an Arrow function cuts a document with, many times as fast as the column expressions.

Results are those of text.py and chunking.py (held against them by a test): classes of characters are spelt out, as Python's
\\w, \\b and \\s differ from the JVM's in marks, joiners, numerals and separators.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .stopwords import ENGLISH
from .text import _OPENER, _SPACE, ENDINGS

OVERLAP, SHORT_TAIL = 10, 16
_WHITE = "[" + _SPACE + "]"
_BLANK = re.compile(_WHITE + "+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LINES = re.compile("\n{3,}")
_RUNS = re.compile(r"[a-zA-Z]+\d+|\d+[a-zA-Z]+|[a-zA-Z]+|\d+|[^a-zA-Z\d]+")
_PLAIN = re.compile("[a-zA-Z]+")
_FAR = re.compile("[\U00010000-\U0010ffff]")
_ALPHABETIC = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))  # letters in circles and squares


@lru_cache(None)
def word_class(top: int = 0x110000) -> str:
    """The inside of a class of the characters under `top` that (?U)\\w matches in the JVM: alphabetic ones, marks, decimal digits, connectors, joiners."""
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"}
    more = {c for a, b in _ALPHABETIC for c in range(a, b + 1)} | {0x200C, 0x200D}
    out, first = [], None
    for c in range(top + 1):
        is_word = c < top and (unicodedata.category(chr(c)) in kinds or c in more)
        if is_word and first is None:
            first = c
        elif not is_word and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


def _top(text: str) -> int:
    """A bound on the text's characters: a class without those beyond the first plane is a bitmap, the other a long list."""
    return 0x110000 if _FAR.search(text) else 0x10000


@lru_cache(None)
def _words(top: int, longer_than: int, also: str = "") -> re.Pattern:
    return re.compile(f"[{word_class(top)}]{{{longer_than + 1},}}{also}")


@lru_cache(None)
def _boundary(top: int, endings: str) -> re.Pattern:
    """An ending, or a dot that is beside no lone letter, and white space before an opener; the cut is after its first character."""
    ends = "".join("\\" + c if c in "\\]^-[&" else c for c in endings)
    w = word_class(top)
    dot = "" if "." in endings else rf"(?:(?<!\.)|(?<!(?<![{w}])[A-Za-z]\.)(?![A-Za-z](?![{w}])))"
    return re.compile(rf"[{ends}.]{dot}{_WHITE}*(?={_OPENER})")


@lru_cache(None)
def _packed(most: int) -> re.Pattern:
    """As many words as fit into less than `most` characters, or one longer word."""
    return re.compile(rf"[^ ].{{0,{most - 2}}}(?= |$)|[^ ]+" if most > 1 else "[^ ]+", re.S)


def sentences(text: str, endings: str = ENDINGS) -> list[str]:
    out, at = [], 0
    for m in _boundary(_top(text), endings).finditer(text):
        out.append(text[at : m.start() + 1])
        at = m.end()
    out.append(text[at:])
    return [s for s in (x.strip(_SPACE) for x in out) if s]


def comma_pieces(text: str) -> list[str]:
    for c in ",;，；":
        text = text.replace(c, c + "\n")
    if "\n" not in text:
        text = text.strip(_SPACE)
        return [text] if text else []
    return [s for s in [x.strip(_SPACE) for x in text.split("\n")] if s]


def space_pieces(text: str, most: int) -> list[str]:
    # str.split() also takes four separators for white space
    words = text.split() if not _SEPARATORS.search(text) else [w for w in _BLANK.split(text) if w]
    out = _packed(most).findall(" ".join(words))
    return ["", *out] if words and len(words[0]) + 1 > most else out


def segments(text: str | None, most: int = 100, endings: str = ENDINGS, pdf: bool = False) -> list[str]:
    out: list[str] = []
    text = text or ""
    if pdf:
        text = _BLANK.sub(" ", _LINES.sub("\n", text))
    for s in sentences(text, endings):
        if len(s) <= most:
            out.append(s)
        else:
            for p in comma_pieces(s):
                if len(p) <= most:
                    out.append(p)
                else:
                    out += space_pieces(p, most)
    return out


def weighted_length(text: str) -> int:
    """The sum is taken in the order of the runs, as its floor depends on it."""
    text = _BLANK.sub("", text)
    if _PLAIN.fullmatch(text):
        return 0
    total = 0.0
    for m in _RUNS.findall(text):
        first = m[0]
        if "a" <= first <= "z" or "A" <= first <= "Z":
            total += 0.47 if not m[-1].isdecimal() else len(m) * 0.01
        else:
            total += len(m) * 0.01 if first.isdecimal() else len(m)
    return int(total)


def chunk_ranges(lengths: list[int], most: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """First and last segment of each chunk: chunking.chunk_ranges()."""
    out, start, total = [], 0, 0
    for i, x in enumerate(lengths):
        if x > most:
            if start < i:
                out.append((start, i - 1))
            out.append((i, i))
            start, total = i + 1, 0
        elif start < i and total + x > most:
            out.append((start, i - 1))
            lap, j = lengths[i - 1], i - 2
            while j >= start and lap + lengths[j] <= overlap:
                lap += lengths[j]
                j -= 1
            start, total = j + 1, lap + x
        else:
            total += x
    if start < len(lengths):
        out.append((start, len(lengths) - 1))
    return out


@lru_cache(None)
def _kinds() -> np.ndarray:
    """By character: 0 white, 1 a letter from A to Z, 2 a decimal digit, 3 all else."""
    out = np.full(0x110000, 3, np.uint8)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]] = 2
    out[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1
    out[[ord(c) for c in _SPACE]] = 0
    return out


def weighted_lengths(texts: list[str]) -> np.ndarray:
    """weighted_length() of each, in hundredths; where these come out even, the floor hangs on the order of the sum, which is then taken."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    kind = _kinds()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts)), size)
    dark = np.flatnonzero(kind)
    kind, of = kind[dark], of[dark]
    if not len(kind):
        return np.zeros(len(texts), np.int64)
    start = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (of[1:] != of[:-1])]))
    length, kind, of = np.diff(np.append(start, len(kind))), kind[start], of[start]
    first = np.concatenate([[True], (of[1:] != of[:-1]) | (kind[1:] == 3) | (kind[:-1] == 3)])  # of runs of letters and digits by turns
    at = np.arange(len(kind))
    place = at - at[first][np.cumsum(first) - 1]
    second = place % 2 == 1  # joins the run before
    joined = np.append(second[1:], False)
    parts = np.where(kind == 3, 100 * length, np.where((kind == 1) & ~joined & ~second, 47, length))
    whole = np.bincount(of, parts, len(texts)).astype(np.int64)
    out = whole // 100
    unsure = np.bincount(of, kind != 3, len(texts)) > 0
    for i in np.flatnonzero(unsure & (whole % 100 == 0)):
        out[i] = weighted_length(texts[i])
    return out


def tokens(text: str | None, stopwords: frozenset[str] = frozenset(ENGLISH), longer_than: int = 2) -> list[str]:
    return [w for w in _words(_top(text or ""), longer_than).findall(text or "") if w not in stopwords]


@dataclass(frozen=True)
class Cut:
    """How a text is cut into chunks, and chunks into tokens."""

    most: int = 150
    overlap: int = OVERLAP
    endings: str = ENDINGS
    pdf: bool = False
    stopwords: frozenset[str] = field(default=frozenset(ENGLISH), repr=False)


class Chunks:
    """The chunks of some documents: segments of all of them, and ranges of segments; two ranges make a chunk that a short one was added to."""

    def __init__(self, texts: list[str | None], cut: Cut):
        self.segments: list[str] = []
        self.ends, ranges, chunk, self.count = [], [], [], []  # of each document: where its segments end; ranges, their chunks; how many chunks
        for t in texts:
            self.segments += segments(t, cut.most, cut.endings, cut.pdf)
            self.ends.append(len(self.segments))
        lengths, at, made = weighted_lengths(self.segments).tolist(), 0, 0
        for end in self.ends:
            own = [(at + a, at + b) for a, b in chunk_ranges(lengths[at:end], cut.most, cut.overlap)]
            n = len(own)
            ranges += own
            chunk += range(made, made + n)
            if n >= 2 and weighted_length(" ".join(self.segments[own[-1][0] : own[-1][1] + 1])) < SHORT_TAIL:
                chunk[-1] -= 1
                n -= 1
            self.count.append(n)
            at, made = end, made + n
        self.ranges, self.chunk = np.array(ranges, np.int64).reshape(-1, 2), np.array(chunk, np.int64)

    def texts(self) -> list[str]:
        out: list[str] = []
        for (a, b), k in zip(self.ranges.tolist(), self.chunk.tolist()):
            text = " ".join(self.segments[a : b + 1])
            if k < len(out):
                out[k] += " " + text
            else:
                out.append(text)
        return out

    def tokens(self, cut: Cut, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct tokens, all segments' tokens one after another as numbers of these, and at which of them each segment begins, and the last ends."""
        found, at = [], 0
        for end in self.ends:
            text = "\0".join(self.segments[at:end]) + "\0" * (end > at)
            if text.count("\0") > end - at:  # texts with that character
                text = "".join(s.replace("\0", " ") + "\0" for s in self.segments[at:end])
            if lower:
                text = text.lower()
            found += _words(_top(text), 2, "|\0").findall(text)
            at = end
        names, code = numbered(found)
        mark, stop = (np.array([w in x for w in names], bool)[code] for x in (("\0",), cut.stopwords))
        kept = ~mark & ~stop
        return names, code[kept], np.concatenate([[0], np.cumsum(kept)[mark]]).astype(np.int64)


def numbered(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words in order, and each word as its place there."""
    names = sorted(set(words))
    place = {w: i for i, w in enumerate(names)}
    return names, np.fromiter(map(place.__getitem__, words), np.int64, len(words))
