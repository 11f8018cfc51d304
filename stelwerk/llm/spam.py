"""Keyword-stuffed pages, link lists and tag lists, told by the shapes of their lines.

A text is cut into lines: at line ends, behind sentence ends, and after LINE words at most. Each line is reduced to a
shape: how many words it has, how many of them are short or stand there twice, its capitals, separators and links. Some
shapes are those of sentences, whatever the language: short words among the others, few separators, links and repeats. The
lines of a page are grouped by shape, and a page is flagged if few shapes that are no sentences hold most of its words.
No word is looked up. One pass over the texts without a shuffle; the shapes of a whole batch are found at once by array
operations on its characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words a line, and letters a short word.
LINE = 16
SHORT = 3
#: A line is shaped like a sentence if it has LEAST words, a short one among them, at most one separator to SEPARATED words,
#: one link to LINKED and this share of words that stand in it twice.
LEAST = 3
SEPARATED = 3
LINKED = 4
REPEATED = 0.4
#: A page is flagged if its TOP most frequent other shapes hold at least DOMINANT of its words. Of fewer than WHOLE words
#: there is no whole to judge.
TOP = 6
DOMINANT = 0.5
WHOLE = 8
#: Characters worked on at once; longer texts are taken in parts that end at white space.
PART = 1 << 20

_TAG = re.compile(r"<(/?)([a-zA-Z])[^<>]*+>")
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]++|[\w-]++(?:\.[\w-]++)+/[^\s<>\"')\]]*+")
_BLANK = re.compile(r"\s")
_SEPARATORS = "#|•·»>,;:/–—-$€£()[]"  # a hyphen only behind white space
_MARK = "\x01"  # a link
_SPACE, _BREAK, _END, _LOWER, _UPPER, _ALONE, _SEP, _OTHER, _NONE, _LINKED = range(10)
_SIZES = ("0", "1", "2", "3-5", "6-9", "10+")
_CAPS = ("none", "first", "some", "most")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its class, and a number that is the same for both cases of a letter. Letters of scripts without
    spaces are words of their own; invisible characters and accents written apart are passed over."""
    kind = np.full(0x110000, _LOWER, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint64)
    for c in (*range(0x3000), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000)):
        ch = chr(c)
        k = unicodedata.category(ch)
        kind[c] = _UPPER if k in ("Lu", "Lt") else _NONE if k in ("Cf", "Mn", "Me") else _LOWER if k[0] in "LM" else _SPACE if k[0] == "Z" else _OTHER
        if len(low := ch.lower()) == 1:
            lower[c] = ord(low)
    for a, b in ((0xE00, 0xEE0), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0xA000), (0x20000, 0x32000)):
        kind[a:b] = np.where(kind[a:b] == _LOWER, _ALONE, kind[a:b])
    kind[0x3000] = _SPACE
    kind[0x3001:0x3040] = _OTHER
    for chars, k in (("\n\r\t\x0b\x0c\x85  ", _BREAK), (".!?。！？", _END), (_SEPARATORS, _SEP), (_MARK, _LINKED)):
        kind[[ord(c) for c in chars]] = k
    return kind, lower * np.uint64(0x9E3779B97F4A7C15) ^ lower << np.uint64(21)


def _plain(text: str) -> str:
    """The text with a mark for each link and without tags."""
    if _MARK in text:
        text = text.replace(_MARK, " ")
    if "<" in text:
        text = _TAG.sub(lambda m: f" {_MARK} " if m[2] in "aA" and not m[1] else " ", text)
    return _LINK.sub(f" {_MARK} ", text) if "/" in text or "www." in text else text


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cut = max((text.rfind(c, at + 1, at + PART) for c in ("\n", " ")), default=-1)
        if cut <= at:
            cut = m.start() if (m := _BLANK.search(text, at + PART)) else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _runs(change: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... that grow where ``change`` is true; the first element is in run 0."""
    return np.cumsum(change) - (1 if len(change) and change[0] else 0)


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with words or links, in order: the index of its text, its words (links count as words), whether it is
    shaped like a sentence, and its shape's number (shape_name)."""
    kind_of, number_of = _tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.array([len(t) + 1 for t in texts], dtype=np.int64))[: len(codes)]
    kind = kind_of[codes]
    blank = np.concatenate(([True], (kind[:-1] == _SPACE) | (kind[:-1] == _BREAK)))
    kind[(codes == ord("-")) & ~blank] = _OTHER
    shown = kind != _NONE
    codes, owner, kind = codes[shown], owner[shown], kind[shown]
    none = tuple(np.zeros(0, dtype=t) for t in (np.int32, np.int64, bool, np.int64))
    if not len(kind):
        return none

    letter = (kind == _LOWER) | (kind == _UPPER) | (kind == _ALONE)
    alone = kind == _ALONE
    before = np.concatenate(([False], letter[:-1] & ~alone[:-1]))
    begins = letter & (~before | alone)
    breaks = (kind == _BREAK) | ((kind == _SPACE) & np.concatenate(([False], kind[:-1] == _END)))
    line_of = np.cumsum(breaks, dtype=np.int32)

    unit = np.flatnonzero(begins | (kind == _LINKED))  # words and links
    if not len(unit):
        return none
    line = line_of[unit]
    first = np.concatenate(([True], line[1:] != line[:-1]))
    starts = np.flatnonzero(first)
    within = np.arange(len(unit)) - starts[np.cumsum(first) - 1]
    piece = _runs(first | (within % LINE == 0))
    size = int(piece[-1]) + 1
    is_link = kind[unit] == _LINKED

    # Length and hash of each word, over its letters.
    at = np.flatnonzero(letter)
    word_at = np.cumsum(begins[at]) - 1
    word_start = np.flatnonzero(begins)
    offset = (at - word_start[word_at]).astype(np.uint64)
    value = number_of[codes[at]] * (offset * np.uint64(2) + np.uint64(0xD1B54A32D192ED03))
    heads = np.flatnonzero(begins[at])
    hashes = np.add.reduceat(value, heads) if len(heads) else np.zeros(0, dtype=np.uint64)
    letters = np.bincount(word_at, minlength=len(heads))
    word_piece = piece[~is_link]
    upper = kind[word_start] == _UPPER

    long = letters > SHORT
    key = (hashes ^ word_piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[long]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True

    count = lambda where: np.bincount(where, minlength=size)
    words, links = count(word_piece), count(piece[is_link])
    short, repeats, caps = count(word_piece[~long]), count(word_piece[long][twice]), count(word_piece[upper])
    led = count(word_piece[upper & first[~is_link]])

    sep = np.flatnonzero(kind == _SEP)  # belongs to the word before it in its line, else to the one behind it
    near = np.searchsorted(unit, sep, "right") - 1
    near = np.where((near >= 0) & (line[np.maximum(near, 0)] == line_of[sep]), near, np.minimum(near + 1, len(unit) - 1))
    fits = line[near] == line_of[sep]
    sep, near = sep[fits], near[fits]
    seps = count(piece[near])
    kinds = np.searchsorted(_SEP_CODES, codes[sep])
    many = np.bincount(piece[near] * len(_SEP_CODES) + kinds, minlength=size * len(_SEP_CODES)).reshape(size, -1)
    main = np.where(seps > 0, many.argmax(axis=1) + 1, 0)

    sentence = (words >= LEAST) & (short > 0) & (links * LINKED <= words) & (seps * SEPARATED <= words) & (repeats <= REPEATED * words)
    sizes = np.searchsorted([0, 1, 2, 5, 9], words, "left")
    cased = np.where(caps == 0, 0, np.where((caps == 1) & (led == 1), 1, np.where(caps * 2 > words, 3, 2)))
    shape = (((sizes * 4 + cased) * (len(_SEP_CODES) + 1) + main) * 2 + (links > 0)) * 2 + (repeats > REPEATED * words)
    return owner[unit][np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))], words + links, sentence, shape


_SEP_CODES = np.array(sorted(map(ord, _SEPARATORS)), dtype=np.uint32)


def shape_name(shape: int) -> str:
    """``words, capitals, main separator, link, repeated``, the last three only where there is one."""
    shape, repeated = divmod(shape, 2)
    shape, link = divmod(shape, 2)
    shape, main = divmod(shape, len(_SEP_CODES) + 1)
    size, caps = divmod(shape, 4)
    parts = [f"{_SIZES[size]} words", f"capitals {_CAPS[caps]}", chr(_SEP_CODES[main - 1]) if main else "", "link" if link else "", "repeated" if repeated else ""]
    return ", ".join(p for p in parts if p)


def judge(texts: list[str]) -> list[tuple[int, int, str | None, int, bool]]:
    """Per text: words, words in lines shaped like sentences, the other shape with most words and its words, flagged."""
    cut = [(i, p) for i, t in enumerate(texts) for p in _parts(_plain(t))]
    part_of = np.array([i for i, _ in cut], dtype=np.int64)
    own, words, sentence, shape = [], [], [], []
    held, room = [], 0
    for k, (_, p) in enumerate(cut):
        held.append(p)
        room += len(p)
        if room >= PART or k == len(cut) - 1:
            o, w, s, x = lines(held)
            own.append(part_of[k + 1 - len(held) + o])
            words.append(w), sentence.append(s), shape.append(x)
            held, room = [], 0
    if not cut:
        return []
    own, words, sentence, shape = map(np.concatenate, (own, words, sentence, shape))
    total = np.bincount(own, weights=words, minlength=len(texts)).astype(np.int64)
    inside = np.bincount(own[sentence], weights=words[sentence], minlength=len(texts)).astype(np.int64)
    other = ~sentence
    groups, at = np.unique(own[other] << 32 | shape[other], return_inverse=True)
    sums = np.bincount(at, weights=words[other], minlength=len(groups)).astype(np.int64)
    order = np.lexsort((groups & 0xFFFFFFFF, -sums, groups >> 32))
    doc, sums, shapes = groups[order] >> 32, sums[order], groups[order] & 0xFFFFFFFF
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
    top = np.bincount(doc[rank < TOP], weights=sums[rank < TOP], minlength=len(texts)).astype(np.int64)
    flagged = (total >= WHOLE) & (top >= DOMINANT * total)
    most: dict[int, tuple[str, int]] = {int(doc[h]): (shape_name(int(shapes[h])), int(sums[h])) for h in head}
    return [(int(total[i]), int(inside[i]), *most.get(i, (None, 0)), bool(flagged[i])) for i in range(len(texts))]


def pages(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, running_words, top_shape, top_words, is_spam`` per text. ``running_words`` stand in lines shaped
    like sentences; ``top_shape`` is the other shape with most words (null if there is none).

    Null texts give no row; blank ones and texts under WHOLE words are never spam; repeated rows are judged each on their
    own; any length is read whole, a line over the border of a part counts as two; other columns are not read."""
    rows = df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("t")).where("t is not null")
    names = ["n_words", "running_words", "top_shape", "top_words", "is_spam"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                out = judge(part["t"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c, t) for c, t in zip(zip(*out), types)]], names=["doc_id", *names])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, running_words bigint, top_shape string, top_words bigint, is_spam boolean")
