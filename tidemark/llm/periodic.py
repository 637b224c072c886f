"""Periodic runs inside documents by a suffix automaton with link-cut access.

A run is a stretch of words that repeats its first `period` words and that no neighbouring word extends. The automaton
of a stretch is built word by word; its suffix links form a tree in which the ancestors of a prefix's state are the
suffixes of that prefix. A link-cut forest over this tree keeps, for every path, the place at which the suffixes on it
ended last. Appending word `r` accesses its state: the path to the root is recoloured to `r`, and on the way every piece
of an old path tells that the suffixes of up to `length` words, which end at `r`, also ended at its colour `e`. If
`r - e <= length`, the last `2 * (r - e)` words are a square. A square whose half is no power of a shorter word always
shows up, since the last place at which its half ended is exactly one half before. Squares of one period that end at
consecutive words are one run.

Most words lie in no run. A run of at least `LEAST` words and `TIMES` periods has windows of `least_overlap()` words that
occur again one period later, and they cover all of it. Therefore only stretches covered by windows that occur again
within a distance that fits into the stretch are given to the automaton. This leaves out no run; equal hashes of
different windows only add stretches.

Memory: a document's words and the automata of its stretches, one at a time, live in one task (some 400 bytes for each
word of a stretch); blocks hold at most `BLOCK` words or one longer document.

Cases: a null or empty text has no words, no runs and an empty collapsed text; a null id is carried; repeated rows give
repeated rows; an empty table gives an empty result; a very long text is one unit and is read whole. Ties are kept, as
all runs are returned. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import Windows, cut, list_lengths, ragged, with_words, word_hashes
from tidemark.llm.common import whole_text

#: A run has at least this many words and this many periods.
LEAST, TIMES = 24, 3

#: Words of a block of documents.
BLOCK = 1 << 18

Run = tuple[int, int, int]


def least_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The least number of words over which a run agrees with itself one period later."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


class SuffixAutomaton:
    """Suffix automaton of a sequence of numbers: `length` and `link` of every state, and the state of every prefix."""

    def __init__(self, words: Sequence[int]):
        self.length, self.link, self.prefixes = [0], [-1], []
        follow: list[dict[int, int]] = [{}]
        length, link = self.length, self.link
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            at = last
            while at >= 0 and word not in follow[at]:
                follow[at][word] = state
                at = link[at]
            if at >= 0:
                target = follow[at][word]
                if length[target] == length[at] + 1:
                    link[state] = target
                else:
                    clone = len(length)
                    length.append(length[at] + 1)
                    link.append(link[target])
                    follow.append(dict(follow[target]))
                    link[target] = link[state] = clone
                    while at >= 0 and follow[at].get(word) == target:
                        follow[at][word] = clone
                        at = link[at]
            self.prefixes.append(state)
            last = state


class LinkCutPaths:
    """Preferred paths of a rooted tree as splay trees ordered by depth; every path has one colour, 0 at first."""

    def __init__(self, parents: Sequence[int]):
        # node 0 means none, so tree nodes are numbered from 1
        self.up = [0, *(p + 1 for p in parents)]
        self.low, self.high = [0] * len(self.up), [0] * len(self.up)
        self.colour = [0] * len(self.up)

    def _splay(self, x: int) -> None:
        """Make x the root of the splay tree of its path; the colour of the path moves to it."""
        up, low, high = self.up, self.low, self.high
        top = x
        while True:
            p = up[x]
            if not p or (low[p] != x and high[p] != x):
                break
            g = up[p]
            zigzag = g and (low[g] == p or high[g] == p)
            if not zigzag:
                top = p
                turns = (x,)
            else:
                top = g
                turns = (p, x) if (low[g] == p) == (low[p] == x) else (x, x)
            for n in turns:
                m = up[n]
                o = up[m]
                if low[m] == n:
                    c = high[n]
                    low[m], high[n] = c, m
                else:
                    c = low[n]
                    high[m], low[n] = c, m
                if c:
                    up[c] = m
                if low[o] == m and o:
                    low[o] = n
                elif high[o] == m and o:
                    high[o] = n
                up[n], up[m] = o, n
        if top != x:
            self.colour[x] = self.colour[top]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to `node`; the pieces of old paths on it, deepest first.

        A piece is its deepest node and its former colour.
        """
        low, high, colours = self.low, self.high, self.colour
        pieces = []
        below, x = 0, node + 1
        while x:
            self._splay(x)
            pieces.append((x - 1, colours[x]))
            rest = high[x]
            if rest:  # the deeper part of the old path goes on as a path of its own
                colours[rest] = colours[x]
            high[x] = below
            below, x = x, self.up[x]
        colours[below] = colour
        return pieces


def squares(words: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ends (counted from 1) and half lengths of all squares whose half is no power of a shorter word."""
    automaton = SuffixAutomaton(words)
    length = automaton.length
    paths = LinkCutPaths(automaton.link)
    for end, state in enumerate(automaton.prefixes, 1):
        pieces = paths.access(state, end)
        for i, (node, before) in enumerate(pieces):
            if before:
                half = end - before
                shorter = length[pieces[i + 1][0]] if i + 1 < len(pieces) else 0
                if shorter < half <= length[node]:
                    yield end, half


def stretch_runs(words: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """Runs (start, length, period) of a sequence, by start and period."""
    open_runs: dict[int, list[int]] = {}  # by period: first and last end of consecutive squares
    found = []

    def close(half: int, first: int, last: int) -> None:
        start = first - 2 * half
        if last - start >= max(least, times * half):
            found.append((start, last - start, half))

    for end, half in squares(words):
        ends = open_runs.get(half)
        if ends is not None and ends[1] == end - 1:
            ends[1] = end
        else:
            if ends is not None:
                close(half, *ends)
            open_runs[half] = [end, end]
    for half, ends in open_runs.items():
        close(half, *ends)
    return sorted(found, key=lambda run: (run[0], run[2]))


def _covered(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches covered by windows of `size` at the ascending `starts`."""
    gap = np.flatnonzero(np.diff(starts) > size)
    first = np.concatenate([starts[:1], starts[gap + 1]])
    last = np.concatenate([starts[gap], starts[-1:]])
    return first, last + size


def repeated_stretches(hashes: np.ndarray, lengths: np.ndarray, least: int = LEAST,
                       times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of a block that can hold runs, from the hashes of its words.

    A window counts if it occurs again in its document at a distance of at most a `times`-th of its stretch; stretches
    shrink until that holds for all.
    """
    size = least_overlap(least, times)
    none = np.zeros(0, np.int64)
    per_doc = np.maximum(lengths - size + 1, 0)
    first = np.cumsum(lengths) - lengths
    starts = ragged(first, per_doc)
    if not len(starts):
        return none, none
    keys = Windows(hashes).hash(starts, size)
    order = np.argsort(keys, kind="stable")
    at, doc = starts[order], np.repeat(np.arange(len(lengths)), per_doc)[order]
    same = (keys[order][1:] == keys[order][:-1]) & (doc[1:] == doc[:-1])
    here, after = at[:-1][same], at[1:][same]
    gap = after - here
    # the nearest other place of every window that has one
    places = np.concatenate([here, after])
    gaps = np.concatenate([gap, gap])
    order = np.lexsort((gaps, places))
    places, gaps = places[order], gaps[order]
    keep = np.concatenate([[True], places[1:] != places[:-1]]) if len(places) else np.zeros(0, bool)
    places, gaps = places[keep], gaps[keep]
    doc_end = np.cumsum(lengths)
    while len(places):
        # windows of two documents that follow each other do not overlap: a window ends within its document
        begin, end = _covered(places, size)
        inner = np.searchsorted(begin, places, side="right") - 1
        # a stretch that crosses a document's end is cut there
        owner = np.searchsorted(doc_end, places, side="right")
        room = np.minimum(end[inner], doc_end[owner]) - np.maximum(begin[inner], doc_end[owner] - lengths[owner])
        fits = (gaps * times <= room) & (room >= least)
        if fits.all():
            break
        places, gaps = places[fits], gaps[fits]
    if not len(places):
        return none, none
    owner = np.searchsorted(doc_end, places, side="right")
    cuts = np.flatnonzero((np.diff(places) > size) | (np.diff(owner) > 0))
    begin = np.concatenate([places[:1], places[cuts + 1]])
    end = np.concatenate([places[cuts], places[-1:]]) + size
    return begin, end


def looped_places(lengths: np.ndarray, seeds: Sequence[int | None]) -> np.ndarray:
    """Index of the word to read at every place of a block.

    A document with a seed g and n words reads its words from a = g % n on in a loop of
    1 + floor((n - a) / (3 + g % 8)) words; all others read themselves.
    """
    places = np.arange(int(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    for i, g in enumerate(seeds):
        n = int(lengths[i])
        if g is None or n == 0:
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        begin = int(first[i]) + a
        places[begin:begin + n - a] = begin + np.arange(n - a) % p
    return places


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  times: int = TIMES, loop_seed: Column | None = None) -> DataFrame:
    """Per document: id, `runs` (start, length, period; by start and period) and `collapsed`.

    `collapsed` is the text's words joined by single spaces without those that lie in a run after its first period.
    `loop_seed` plants runs for trials: see `looped_places`.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    seed = (loop_seed if loop_seed is not None else F.lit(None)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), seed.alias("seed"), whole_text(text_col).alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in cut(with_words(batches), most=BLOCK):
            lists = block["words"]
            lengths = list_lengths(lists)
            words = lists.flatten()
            seeds = block["seed"].to_pylist()
            if any(s is not None for s in seeds):
                words = words.take(pa.array(looped_places(lengths, seeds)))
            hashes = word_hashes(words)
            first = np.cumsum(lengths) - lengths
            found: list[list[dict]] = [[] for _ in lengths]
            drop = np.zeros(len(hashes) + 1, np.int64)
            for begin, end in zip(*(a.tolist() for a in repeated_stretches(hashes, lengths, least, times))):
                doc = int(np.searchsorted(first, begin, side="right")) - 1
                while lengths[doc] == 0:  # empty documents share their first place with the next one
                    doc += 1
                numbers = np.unique(hashes[begin:end], return_inverse=True)[1].tolist()
                for start, length, period in stretch_runs(numbers, least, times):
                    found[doc].append({"start": begin - int(first[doc]) + start, "length": length, "period": period})
                    drop[begin + start + period] += 1
                    drop[begin + start + length] -= 1
            kept = np.cumsum(drop[:-1]) == 0
            totals = np.concatenate([[0], np.cumsum(kept)])
            offsets = np.concatenate([totals[first], totals[-1:]]) if len(lengths) else np.zeros(1, np.int64)
            words = words.filter(pa.array(kept))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")
            for runs in found:
                runs.sort(key=lambda r: (r["start"], r["period"]))
            yield pa.RecordBatch.from_arrays([block["id"], pa.array(found, run_type), collapsed],
                                             ["id", "runs", "collapsed"])

    out = rows.mapInArrow(
        collapse, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of runs, the one with the greatest exponent, and digests; a tenth gets planted loops.

    Exponents are compared exactly: the integer parts first, then the fractions by cross products.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    seed = F.when(h % 10 == 0, F.floor(h / 10))
    runs = collapse_runs(docs, id_col, text_col, loop_seed=seed)

    def better(best: Column, run: Column) -> Column:
        left, right = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (left > right), run).otherwise(best)  # runs come by start, then period

    run_kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(run_kind), better)
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n")))
    return runs.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        id_col, "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
