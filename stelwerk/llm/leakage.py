"""Passages of test items inside corpus documents.

The words of an item block are numbered; a document becomes the numbers of its words, 0 for words no item has. Seeds,
runs of SEED words shared by an item and the document, are found by Karp-Rabin hashes over whole batches of documents
at once. Around each seed greedy string tiling marks the longest non-overlapping common runs first. Tiles give an
item's coverage in whatever order they stand; an exact check of the tiles in order, with the edit distance of the words
between them, decides whether a passage stands there; where it finds none, each run of seeds is judged by itself. The corpus is scanned once and never shuffled: with
more items than one block holds, that scan keeps the documents that may share a seed with any item, and each block reads those.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelwerk.llm.canonical import LOOK_ALIKES
from stelwerk.session import written

#: A passage has at least this many words of the item, and at most one edit to PER_EDIT of them.
PASSAGE = 18
PER_EDIT = 8
#: Words a seed. PASSAGE words with the edits allowed leave a run of at least this many: (18 - 2) / 3, rounded up, and
#: longer passages leave no shorter one.
SEED = 6
#: Factor by which the lengths of tiles looked for fall.
FALL = 4
#: Shortest tile, and the longest stretch between two tiles that is compared word by word.
TILE = 3
GAP = 24
#: Characters of item texts a block; a block with its seeds is sent to all tasks (under 100 MB at this size).
BLOCK_CHARS = 4_000_000
#: Bits of the table of all items' seeds: 16 MB to broadcast, however many items there are.
SEED_BITS = 1 << 27

_TAG = re.compile(r"</?[a-zA-Z][^<>]*+>")
_MARKUP = re.compile(_TAG.pattern + r"|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1 << 16)
def _plain(run: str) -> str:
    run = unicodedata.normalize("NFKD", "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", run)))
    return "".join(c for c in run if unicodedata.category(c) not in ("Mn", "Cf", "Me")).casefold()


def without_markup(text: str) -> str:
    """Tags and comments of any length as spaces. Behind the last ``-->`` no comment ends, so none is looked for there:
    the time taken is in proportion to the text."""
    end = text.rfind("-->") + 3
    return _TAG.sub(" ", text) if end < 3 else _MARKUP.sub(" ", text[:end]) + _TAG.sub(" ", text[end:])


def words(text: str) -> list[str]:
    """Words without case, accents, punctuation, spacing, markup and look-alike characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = without_markup(text)
    if not text.isascii():
        text = _OTHER.sub(lambda m: _plain(m.group()), text)
    return _WORD.findall(text.lower())


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of the ``size`` numbers from each place on, as uint64; shorter by size - 1 than the input."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * _BASE + ids[k : k + n].astype(np.uint64)
    return h


def _common(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The longest common runs of at least ``least`` words: (minus length, document position, item position). Takes memory
    for the places where ``least`` words are equal, not for all pairs of places."""
    h, g = rolling(item, least), rolling(doc, least)
    order = np.argsort(h, kind="stable")
    lo, hi = np.searchsorted(h[order], g, "left"), np.searchsorted(h[order], g, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(g)), n)
    i = order[np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    same = np.ones(len(j), dtype=bool)
    for k in range(least):
        same &= (item[i + k] == doc[j + k]) & (doc[j + k] > 0)
    i, j = i[same], j[same]
    if not len(i):
        return []
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    start = np.concatenate(([0], np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1)) + 1))
    size = np.diff(np.concatenate((start, [len(i)]))) + least - 1
    return list(zip((-size).tolist(), j[start].tolist(), i[start].tolist()))


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, length) of common runs of at least ``least`` words, the
    longest first, ties by document then item position; no word of either side is in two of them.

    Karp-Rabin hashes run over what is not marked yet, for lengths that fall by FALL down to ``least``: the runs of a length
    or more are marked longest first before shorter ones are looked for, so that few places are left by then."""
    item, doc = item.copy(), doc.copy()  # marked words become 0 and -1, which equal nothing
    found: list[tuple[int, int, int]] = []
    size = least
    while size * FALL <= min(len(item), len(doc)):
        size *= FALL
    while size >= least:
        runs = _common(item, doc, size)
        heapq.heapify(runs)
        while runs:
            n, b, a = heapq.heappop(runs)
            n = -n
            taken = (item[a : a + n] <= 0) | (doc[b : b + n] <= 0)
            if taken.any():  # the free parts of a run compete again
                edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - s >= size:
                        heapq.heappush(runs, (s - e, b + s, a + s))
                continue
            item[a : a + n] = -1
            doc[b : b + n] = 0
            found.append((a, b, n))
        size //= FALL
    return found


def _edits(a: list[int], b: list[int]) -> int:
    """Edit distance of two short lists of words; words no item has (0) equal nothing."""
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for x, p in enumerate(a, 1):
        last, row[0] = row[0], x
        for y, q in enumerate(b, 1):
            last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (p != q or not q))
    return row[-1]


def _beyond(item: list[int], doc: list[int]) -> list[int]:
    """For k = 0, 1, ...: the fewest edits between the first k words of the item and any beginning of the document."""
    row = list(range(len(doc) + 1))
    least = [0]
    for x, p in enumerate(item, 1):
        last, row[0] = row[0], x
        for y, q in enumerate(doc, 1):
            last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (p != q or not q))
        least.append(min(row))
    return least


def in_order(item: np.ndarray, doc: np.ndarray, found: list[tuple[int, int, int]]) -> bool:
    """Whether tiles in order make a passage: a stretch of at least PASSAGE item words with at most one edit in PER_EDIT.

    Between tiles the words are compared one by one. A chain of tiles that is too short is filled up at its ends, where
    words stand that are too few for a tile, or edited ones: a passage may begin or end with them."""
    if len(item) < PASSAGE:
        return False
    a_list, b_list = item.tolist(), doc.tolist()
    allowed = PASSAGE // PER_EDIT

    def passes(s: int, at: int, end: int, until: int, e: int) -> bool:
        n = end - s
        if n >= PASSAGE:
            return e * PER_EDIT <= n
        need = PASSAGE - n
        if e > allowed or need > allowed * TILE:  # an edit hides TILE - 1 words beside it at most
            return False
        right = _beyond(a_list[end : end + need], b_list[until : until + need + allowed])
        left = _beyond(a_list[max(0, s - need) : s][::-1], b_list[max(0, at - need - allowed) : at][::-1])
        return any(k < len(left) and need - k < len(right) and e + left[k] + right[need - k] <= allowed for k in range(need + 1))

    ways: list[list[tuple[int, int, int]]] = []  # per tile: (start in the item, edits so far, start in the document)
    order = sorted(found)
    for t, (a, b, n) in enumerate(order):
        own = [(a, 0, b)]
        for (p, q, m), before in zip(order[:t], ways):
            over = max(0, p + m - a, q + m - b)
            if over >= n or a <= p or b <= q or a - p - m > GAP or b - q - m > GAP:
                continue
            cost = _edits(a_list[p + m : a + over], b_list[q + m : b + over])
            own += [(s, e + cost, at) for s, e, at in before]
        best, kept = None, []
        for way in sorted(own):  # none that is worse than another in start and edits
            if best is None or way[1] < best:
                best = way[1]
                kept.append(way)
        if any(passes(s, at, a + n, b + n, e) for s, e, at in kept):
            return True
        ways.append(kept)
    return False


def _merged(seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Seeds at successive places of both texts become one run: (document position, item position, length)."""
    runs: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}  # by diagonal, the run it may go on
    for at, p in seeds:  # in the order of the text
        k = last.get(at - p)
        if k is not None and runs[k][0] + runs[k][2] - SEED + 1 == at:
            runs[k] = (runs[k][0], runs[k][1], runs[k][2] + 1)
        else:
            last[at - p] = len(runs)
            runs.append((at, p, SEED))
    return runs


def _possible(items: np.ndarray, ip: np.ndarray, docs: np.ndarray, dp: np.ndarray) -> np.ndarray:
    """For each seed (its places in the items' and the documents' words, both padded with zeros): whether a passage may pass
    through it. All seeds of a batch are judged at once, so a phrase that thousands of items share costs no work of its own.

    No passage is lost. One of 2 * PASSAGE words or more can be cut into parts of PASSAGE to 2 * PASSAGE - 1, of which one has
    no more edits than its own length allows, at most (2 * PASSAGE - 1) / PER_EDIT = 4. Take that part, with e edits allowed
    at its length; its other words stand in at most e + 1 runs, all on diagonals at most e from one another. The longest run
    has SEED words, so at most e runs are single words. Of any w item words of the part, then, at most 2 * e are edited or
    single, and the other w - 2 * e stand in pairs on a diagonal at most e from the seed's. That is asked of some stretch of w
    item words around the seed, for each e, with w the shortest part that allows e edits (_STRETCHES)."""
    reach, most = _STRETCHES[-1][0] - 1, (2 * PASSAGE - 1) // PER_EDIT
    width = SEED + 2 * reach
    ok = np.zeros(len(ip), dtype=bool)
    for k in range(0, len(ip), 4096):
        a = items[ip[k : k + 4096, None] + np.arange(-reach, width - reach)]
        b = docs[dp[k : k + 4096, None] + np.arange(-reach - most, width - reach + most)]
        met = np.zeros(a.shape, dtype=bool)
        for s in range(2 * most + 1):
            same = (a == b[:, s : s + width]) & (a != 0)
            pair = same[:, :-1] & same[:, 1:]
            met[:, :-1] |= pair
            met[:, 1:] |= pair
        sums = np.cumsum(np.pad(met, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        for w, least in _STRETCHES:
            ok[k : k + 4096] |= (sums[:, w:] - sums[:, :-w]).max(axis=1) >= least
    return ok


#: For e = 2, 3, 4: the shortest part of a passage with e edits, and its words that must stand in pairs.
_STRETCHES = [(max(PASSAGE, e * PER_EDIT), max(PASSAGE, e * PER_EDIT) - 2 * e) for e in range(PASSAGE // PER_EDIT, (2 * PASSAGE - 1) // PER_EDIT + 1)]


def _slack(item: np.ndarray) -> int:
    return GAP + len(item) // PER_EDIT


def _window(item: np.ndarray, doc: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """Where in the document the whole item may stand if its word ``p`` stands at ``at``, with words put in."""
    return max(0, at - p - _slack(item)), min(len(doc), at + len(item) - p + _slack(item))


def windows(item: np.ndarray, doc: np.ndarray, runs: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """The document's words in each window around the runs of seeds, and the tiles there."""
    done = -1
    for at, p, _ in runs:
        if at < done:
            continue
        a, b = _window(item, doc, at, p)
        done = b - _slack(item)
        found = tiles(item, doc[a:b])
        if found:
            yield doc[a:b], found


def alone(item: np.ndarray, doc: np.ndarray, p: int, at: int, n: int) -> bool:
    """Whether a passage passes through a run of ``n`` words (item position ``p``, document position ``at``), whatever
    else the document holds: the run is extended to both sides with the edit distance of the words there.

    Twice PASSAGE words to each side are enough: a longer passage can be cut into parts of PASSAGE to twice that, one of
    which has no more edits than its length allows, and that part has a run of SEED words."""
    if n >= PASSAGE:
        return True
    reach = 2 * PASSAGE
    more = reach + reach // PER_EDIT
    right = _beyond(item[p + n : p + n + reach].tolist(), doc[at + n : at + n + more].tolist())
    left = _beyond(item[max(0, p - reach) : p][::-1].tolist(), doc[max(0, at - more) : at][::-1].tolist())
    return any(n + k + m >= PASSAGE and (x + y) * PER_EDIT <= n + k + m for k, x in enumerate(left) for m, y in enumerate(right))


class Items:
    """A block of items: numbered words, seeds by hash. The words of all items stand in one array with PAD zeros between."""

    PAD = SEED + 4 * PASSAGE

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        for item_id, text in rows:
            self.texts.append(np.array([self.number.setdefault(x, len(self.number) + 1) for x in words(text)], dtype=np.int32))
            self.ids.append(item_id)
        self.flat, self.start = self._padded(self.texts)
        h, at = self._seeds(self.flat)
        order = np.argsort(h, kind="stable")
        self.seed, self.where = h[order], at[order]

    def _padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All words in one array, and where each text begins in it."""
        pad = np.zeros(self.PAD, dtype=np.int32)
        sizes = np.array([len(t) + self.PAD for t in texts], dtype=np.int64)
        return np.concatenate([pad, *(x for t in texts for x in (t, pad))]), self.PAD + np.cumsum(sizes) - sizes

    @staticmethod
    def _seeds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each SEED known words that follow one another."""
        known = np.flatnonzero(np.convolve(flat != 0, np.ones(SEED, dtype=np.int32), "valid") == SEED)
        return rolling(flat, SEED)[known], known

    def near(self, texts: list[str], everything: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """For each text and item that share a seed: index of the text, index of the item, the words of both, the runs of
        seeds (_merged). Unless ``everything``, seeds no passage can pass through are left out (_possible)."""
        if not len(self.seed):
            return
        get = self.number.get
        docs = [np.array([get(w, 0) for w in words(t)], dtype=np.int32) for t in texts]
        flat, start = self._padded(docs)
        h, at = self._seeds(flat)
        lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        dp = np.repeat(at[hit], n)
        ip = self.where[np.arange(len(dp)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)]
        if not everything:
            ok = _possible(self.flat, ip, flat, dp)
            dp, ip = dp[ok], ip[ok]
        d, i = np.searchsorted(start, dp, "right") - 1, np.searchsorted(self.start, ip, "right") - 1
        order = np.lexsort((ip, dp, i, d))
        d, i, dp, ip = d[order], i[order], (dp - start[d])[order], (ip - self.start[i])[order]
        cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) != 0)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(d)]):
            if e > s:
                yield int(d[s]), int(i[s]), self.texts[i[s]], docs[d[s]], _merged(list(zip(dp[s:e].tolist(), ip[s:e].tolist())))

    def matches(self, texts: list[str], everything: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """For each window of a text around a seed shared with an item (near): index of the text, index of the item, the
        words of both, the tiles."""
        for d, i, item, doc, runs in self.near(texts, everything):
            for part, found in windows(item, doc, runs):
                yield d, i, item, part, found

    def covers(self, texts: list[str], least: float = 0.0) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int]]]]:
        """For each text and item that share a seed: index of the text, index of the item, the item's words, the tiles of
        all windows around the seeds together, no word of either side in two of them. Pairs are left out if less than the
        share ``least`` of the item's words is in the text at all."""
        last, there = -1, np.zeros(len(self.number) + 1, dtype=bool)
        for d, i, item, doc, runs in self.near(texts, everything=True):
            if d != last:
                there[:] = False
                there[doc] = True
                last = d
            if there[item].sum() < least * len(item):
                continue
            inside = np.zeros(len(doc) + 1, dtype=np.int64)
            for at, p, _ in runs:
                a, b = _window(item, doc, at, p)
                inside[a] += 1
                inside[b] -= 1
            yield d, i, item, tiles(item, np.where(np.cumsum(inside[:-1]) > 0, doc, 0))


def _blocks(items: DataFrame, item: str, text: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for i, t in items.select(item, text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        if rows and size + len(t) > chars:
            yield rows
            rows, size = [], 0
        rows.append((i, t))
        size += len(t)
    if rows:
        yield rows


_INDEXES: dict[str, Items] = {}


def _index(name: str, sent) -> Items:
    """The index of a block, made once a process; the block before it goes."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Items(sent.value)
    return _INDEXES[name]


def _seed_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each seed of the texts: the index of its text, and its place in a table of SEED_BITS bits."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], dtype=np.int64) for t in texts]
    hashes = pd.util.hash_array(np.array(list(number), dtype=object), categorize=False) if number else np.zeros(0, dtype=np.uint64)
    own = [rolling(hashes[d], SEED) for d in docs]
    of = np.repeat(np.arange(len(own)), [len(h) for h in own])
    return of, (np.concatenate([np.zeros(0, np.uint64), *own]) >> np.uint64(20)) % np.uint64(SEED_BITS)


def _candidates(rows: DataFrame, items: DataFrame, item_text: str) -> DataFrame:
    """The rows (``doc_id, t``) that may share a seed with any item, written once. The items' seeds become one table of bits,
    made in tasks and put together by its parts; the driver gets its SEED_BITS bits and nothing else. Of rows that share no
    seed few are kept, none that does is left out."""
    width = 1 << 16  # bits a part

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            _, bits = _seed_bits([t for t in b["t"].to_pylist() if t])
            for k in np.unique(bits // np.uint64(width)).tolist():
                here = bits[bits // np.uint64(width) == k] % np.uint64(width)
                own.setdefault(k, np.zeros(width, dtype=bool))[here.astype(np.int64)] = True
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], names=["part", "bits"])

    def either(key, table):
        got = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([got.tobytes()], pa.binary())})

    made = items.select(F.col(item_text).alias("t")).mapInArrow(parts, "part int, bits binary").groupBy("part").applyInArrow(either, "part int, bits binary")
    table = np.zeros(SEED_BITS // 8, dtype=np.uint8)
    for r in made.collect():  # at most SEED_BITS bits
        table[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                of, bits = _seed_bits(part["t"].to_pylist())
                at = bits.astype(np.int64)
                hit = sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
                yield part.filter(pa.array(np.isin(np.arange(part.num_rows), of[hit == 1])))

    return written(rows.mapInArrow(keep, rows.schema), "candidates")


def _scan(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str, judge, schema: str, chars: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("t")).where("t is not null")
    names = [p.split()[0] for p in schema.split(", ")]
    result = spark.createDataFrame([], schema)
    blocks = _blocks(items, item, item_text, chars)
    first, second = next(blocks, None), next(blocks, None)
    if second is not None:  # the corpus is scanned once for all items; each block then reads what may hold one
        rows = _candidates(rows, items, item_text)
    for block in (x for x in chain((first, second), blocks) if x):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            known = _index(name, sent)
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    ids = part["doc_id"].to_pylist()
                    out = judge(known, ids, part["t"].to_pylist())
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

        result = result.unionByName(rows.mapInArrow(run, schema))
    return result


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id``, distinct: the document contains a passage of the item, at least PASSAGE words of it in order
    with at most one edit in PER_EDIT words.

    Null and blank texts match nothing, items under PASSAGE words neither; items with equal texts are all reported;
    documents that repeat are each reported under their own id; empty tables give no rows; ids must be integers."""

    def judge(known: Items, ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
        found = set()
        for d, i, a, t, runs in known.near(texts):
            key = (ids[d], known.ids[i])
            # a copy of some of the words nearby can take them from the passage's tiles, so no pair is given up by them
            if key not in found and (any(in_order(a, b, marks) for b, marks in windows(a, t, runs)) or any(alone(a, t, p, at, n) for at, p, n in runs)):
                found.add(key)
        return sorted(found)

    return _scan(docs, items, doc, text, item, item_text, judge, "doc_id bigint, item_id bigint", block_chars).distinct()


def coverage(docs: DataFrame, items: DataFrame, least: float = 0.5, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, covered, longest, coverage``: pairs whose tiles, in any order, cover at least the share
    ``least`` of the item's words, so reordered and scattered passages too: the tiles around all seeds of a document count
    together. Of documents with one id the fullest counts."""

    def judge(known: Items, ids: list[int], texts: list[str]) -> list[tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for d, i, a, marks in known.covers(texts, least):
            n = sum(m for _, _, m in marks)
            if n >= least * len(a):
                key = (ids[d], known.ids[i])
                best[key] = max(best.get(key, (0, 0, 0.0)), (n, max(m for _, _, m in marks), round(n / len(a), 4)))
        return [(*k, *v) for k, v in sorted(best.items())]

    return _scan(docs, items, doc, text, item, item_text, judge, "doc_id bigint, item_id bigint, covered bigint, longest bigint, coverage double", block_chars).groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
