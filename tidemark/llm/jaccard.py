"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed shingles of `SHINGLE` words (a shorter text is one shingle). Rows with the same words are one
node. A node's set is embedded as `TOKENS` min-hash tokens, two of which agree with the probability of the similarity.
In each of `RUNS` runs a node draws about `DRAWN` of its tokens by a hash that all nodes share, and joins a bucket per
drawn token. A bucket is compared by brute force, all pairs of it, if that takes at most `PAIRS` comparisons; else it is
first split along the path with more tokens drawn, `DEPTH` levels at most. A bucket that keeps `SAME` of its parent is a
group of near copies, which no path can split, and is compared in chunks.

A pair belongs to the first of all compared buckets that it shares, over all runs and levels, and is a candidate there
only. Candidates are verified on the exact sets by blocks: up to `BLOCK` nodes on a side of a large bucket, or the
buckets of up to `BRUTE` nodes among `BLOCK` rows. A node's set is sent once to a block, however many links it has there.

Recall: runs are repeated until a pair at the threshold is missed with at most `MISS`. Such a pair shares a drawn token
with probability 1 - exp(-DRAWN * 0.8) = 0.80 per run at the first level, which takes `RUNS` = 6. Along a path a shared
bucket has 1.25 * 0.8 = 1 shared one on average, so a pair all of whose buckets are split is found in fewer runs: nodes of
split buckets get more, as many as the deepest level reached asks for (10 after one level, 22 after five). The bound on
the estimate from the tokens, three deviations below the threshold, misses another 0.2 %.

The result has the class of each row (connected links) and its number of links, that is of verified links to other
texts. Links are not listed: a block returns the number of links of each of its nodes, which add up, as every link belongs
to one block, and a spanning forest of its links, from which the classes are found. All links are compared, so a large
group of near copies takes the square of its size in comparisons, but not in rows.

Cases: texts without words have no shingles and link to nothing; a null id is larger than any other; rows that repeat a
text are copies of one node; rows that repeat an id with other texts are different nodes; an empty table gives an empty
result. Only id and text are read. Scratch tables go to the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import (Windows, ascii_words, cut, list_lengths, mixed, ragged, with_words,
                                 word_hashes)
from tidemark.llm.common import giving_back, once, stored, whole_text
from tidemark.llm.exact_dedup import possibly_repeated, with_filter_place

SHINGLE, TOKENS, RUNS, DRAWN, DRAWN_LATER = 5, 64, 6, 2.0, 1.25
BRUTE, DEPTH, SALTS, CHUNK, BLOCK, PAIRS, SAME = 128, 6, 32, 2048, 1024, 1 << 23, 0.75

#: Similarity of a link as a fraction, and the agreeing tokens that a candidate needs.
NUMERATOR, DENOMINATOR, CANDIDATE = 4, 5, 41

#: Probability with which the runs may miss a pair at the threshold.
MISS = 1e-4

LAST = np.iinfo(np.int64).max
_PLACE = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = mixed(np.arange(101, 101 + TOKENS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


# ------------------------------------------------------------------ sets, sketches and paths in numpy

def shingles(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every document, one after the other, and their number per document (repeats included)."""
    lengths = list_lengths(lists)
    windows = Windows(word_hashes(lists.flatten()))
    counts = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
    starts = ragged(np.cumsum(lengths) - lengths, counts)
    return windows.hash(starts, np.repeat(np.minimum(lengths, SHINGLE), counts)), counts


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Min-hash tokens of every document that has shingles (documents x TOKENS)."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(first), TOKENS), np.uint32)
    for i in range(TOKENS if len(first) else 0):
        out[:, i] = np.minimum.reduceat((hashes * _FACTOR[i]) >> np.uint64(32), first)
    return out


def drawn(tokens: np.ndarray, path: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths that go on: the rows and their new path, one for each token drawn for the row's path."""
    draw = mixed(tokens.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + _PLACE + mixed(path)[:, None])
    row, place = np.nonzero(draw < np.uint64(int(most / TOKENS * 2.0 ** 64)))
    return row, mixed(draw[row, place] + np.uint64(1))


def runs_for(level: int) -> int:
    """Runs after which a pair at the threshold is missed with at most `MISS`, if it meets at this level of its paths.

    The buckets that a pair shares are a branching process with Poisson offspring; `ends` is the probability that the
    branch of one shared bucket has ended before the level.
    """
    at, ends = NUMERATOR / DENOMINATOR, 0.0
    for _ in range(level):
        ends = math.exp(-DRAWN_LATER * at * (1 - ends))
    return max(RUNS, math.ceil(-math.log(MISS) / (DRAWN * at * (1 - ends))))


def matrix(column: pa.Array) -> np.ndarray:
    """Sketches of a batch from their bytes, which follow each other in its buffer."""
    if not len(column):
        return np.zeros((0, TOKENS), np.uint32)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[first:first + len(column) * TOKENS * 4].view(np.uint32).reshape(-1, TOKENS)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches in which the rows of a bucket follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        if held and held[-1]["key"][-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def agreeing(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many tokens of every sketch agree with those of one."""
    lanes = (tokens == row).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return ((lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def bucket_edges(key: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]


class Before:
    """The keys of a node's compared buckets before this one, `smaller`, of all rows of a table."""

    def __init__(self, table: pa.Table):
        self.lists = table["smaller"].combine_chunks() if "smaller" in table.column_names else None
        if self.lists is not None:
            self.counts = list_lengths(self.lists)
            self.starts = np.cumsum(self.counts) - self.counts
            known, self.ids = np.unique(self.lists.flatten().to_numpy(), return_inverse=True)
            self.many = len(known)
            self.codes = np.sort(np.repeat(np.arange(len(self.counts)), self.counts) * self.many + self.ids)

    def first_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows of each pair meet in no bucket before this one."""
        if self.lists is None or not self.many or not len(i):
            return np.ones(len(i), bool)
        pair = np.repeat(np.arange(len(i)), self.counts[i])
        codes = j[pair] * self.many + self.ids[ragged(self.starts[i], self.counts[i])]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.bincount(pair[self.codes[at] == codes], minlength=len(i)) == 0


def small_bucket_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of the buckets of at most `BRUTE` nodes, those of buckets that begin in the same `BLOCK` rows together."""
    tokens, before = np.ascontiguousarray(matrix(table["sketch"].combine_chunks())), Before(table)
    edges = np.array(bucket_edges(table["key"].to_numpy()))
    sizes = np.diff(edges)
    starts = edges[:-1][is_small(table, edges)]
    sizes = sizes[is_small(table, edges)]
    cuts = np.flatnonzero(np.diff(starts // BLOCK)) + 1
    for start, size in zip(np.split(starts, cuts), np.split(sizes, cuts)):
        rows = ragged(start, size)
        after = np.repeat(start + size, size) - rows - 1
        i, j = np.repeat(rows, after), ragged(rows + 1, after)
        near = agreeing(tokens[j], tokens[i]) >= CANDIDATE
        i, j = i[near], j[near]
        first = before.first_here(i, j)
        if first.any():
            yield i[first], j[first]


def is_small(table: pa.Table, edges: np.ndarray) -> np.ndarray:
    """Which buckets are whole and of at most `BRUTE` nodes."""
    small = np.diff(edges) <= BRUTE
    if "seeker" in table.column_names:
        small &= table["seeker"].is_null().to_numpy()[edges[:-1]]
    return small


def bucket_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of every larger bucket of a table by their rows, and, where `seeker` is set, those of seekers with the
    others of any bucket."""
    key, node = (table[c].to_numpy() for c in ("key", "node"))
    tokens, before = np.ascontiguousarray(matrix(table["sketch"].combine_chunks())), Before(table)
    sides = table["seeker"].to_pylist() if "seeker" in table.column_names else [None] * len(key)
    edges = np.array(bucket_edges(key))
    larger = ~is_small(table, edges)
    for lo, hi in zip(edges[:-1][larger].tolist(), edges[1:][larger].tolist()):
        whole = sides[lo] is None
        side = np.array([bool(x) for x in sides[lo:hi]])
        met = None if whole else lo + np.flatnonzero(~side)
        theirs = None if whole else tokens[met]
        for i in range(lo, hi - 1) if whole else (lo + np.flatnonzero(side)).tolist():
            if whole:
                j = i + 1 + np.flatnonzero(agreeing(tokens[i + 1:hi], tokens[i]) >= CANDIDATE)
            else:
                j = met[agreeing(theirs, tokens[i]) >= CANDIDATE]
                j = j[node[j] != node[i]]
            j = j[before.first_here(np.full(len(j), i), j)]
            if len(j):
                yield np.full(len(j), i), j


def block_rows(block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A block of candidates: its key, every node and its partners (none if it is one of others only)."""
    first, count = np.unique(a, return_counts=True)
    alone = np.setdiff1d(b, first)
    sizes = np.concatenate([count, np.zeros(len(alone), np.int64)])
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(mixed(block).view(np.int64), len(sizes))), pa.array(np.concatenate([first, alone])),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                 pa.array(b[np.argsort(a, kind="stable")]))], ["key", "node", "others"])


@giving_back
def partners_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of buckets by blocks: a large bucket gives blocks of at most 2 x `BLOCK` nodes, small ones share one."""
    for table in whole_buckets(batches):
        key, node = table["key"].to_numpy(), table["node"].to_numpy()
        for i, j in small_bucket_pairs(table):
            yield block_rows(key[i[:1]].view(np.uint64), node[i], node[j])
        edges = np.array(bucket_edges(key))
        for of, pairs in itertools.groupby(bucket_pairs(table), lambda p: np.searchsorted(edges, p[0][0], side="right")):
            i, j = (np.concatenate(side) for side in zip(*pairs))
            start = edges[of - 1]
            place = (i - start) // BLOCK * (1 << 20) + (j - start) // BLOCK
            order = np.argsort(place, kind="stable")
            i, j, place = i[order], j[order], place[order]
            cuts = bucket_edges(place)
            for lo, hi in zip(cuts, cuts[1:]):
                yield block_rows(key[start:start + 1].view(np.uint64) + np.uint64(place[lo] + 1), node[i[lo:hi]],
                                 node[j[lo:hi]])


@giving_back
def links_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the candidates of blocks: the number of every linked node, and a spanning forest with `near`."""
    for table in whole_buckets(batches):
        edges = bucket_edges(table["key"].to_numpy())
        for lo, hi in zip(edges, edges[1:]):
            yield block_links(table.slice(lo, hi - lo))


def block_links(block: pa.Table) -> pa.RecordBatch:
    node = block["node"].to_numpy()
    sets, others = block["shingles"].combine_chunks(), block["others"].combine_chunks()
    sizes, ends = list_lengths(sets), np.cumsum(list_lengths(others))
    starts = np.cumsum(sizes) - sizes
    known, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(node)
    partner = order[np.searchsorted(node[order], others.flatten().to_numpy())]
    seen, label = np.zeros(len(known), bool), np.arange(len(node))
    links, a, b = np.zeros(len(node), np.int64), [], []
    for i, lo, hi in zip(range(len(node)), [0, *ends], ends):
        for s in range(lo, hi, 256):
            j = partner[s:min(hi, s + 256)]
            mine = ids[starts[i]:starts[i] + sizes[i]]
            seen[mine] = True
            common = np.add.reduceat(seen[ids[ragged(starts[j], sizes[j])]], np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
            seen[mine] = False
            j = j[common * DENOMINATOR >= (sizes[i] + sizes[j] - common) * NUMERATOR]
            fresh = np.zeros(len(j), bool)
            reached, at = np.unique(label[j], return_index=True)
            fresh[at[reached != label[i]]] = True
            if fresh.any():
                label[np.isin(label, reached)] = label[i]
                a.append(np.full(int(fresh.sum()), node[i]))
                b.append(node[j[fresh]])
            links[i] += len(j)
            np.add.at(links, j, 1)
    linked = np.flatnonzero(links)
    edges = np.concatenate(b) if b else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([node[linked], *a])),
        pa.array(np.concatenate([links[linked], np.zeros(len(edges), np.int64)])),
        pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(edges)])], ["node", "links", "near"])


@giving_back
def next_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of nodes that go on."""
    for batch in batches:
        row, path = drawn(matrix(batch["sketch"]), batch["key"].to_numpy().view(np.uint64), DRAWN_LATER)
        yield pa.RecordBatch.from_arrays(
            [pa.array(path.view(np.int64)), *(pa.array(batch[c].to_numpy()[row]) for c in ("node", "n"))],
            ["key", "node", "was"])


# ------------------------------------------------------------------ Spark jobs

def digest_of(words: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat_ws(" ", words), 256)), 1, 16)


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored: row, id, digest of the words and sketch of every document; no sketch where there are no words."""
    rows = docs.select(
        F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id")).alias("of"),
        whole_text(text_col).alias("text"))

    @giving_back
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in cut(with_words(batches)):
            hashes, counts = shingles(batch["words"])
            made = iter(sketches(hashes, counts))
            column = pa.array([next(made).tobytes() if c else None for c in counts], pa.binary())
            lines = pc.binary_join(batch["words"], " ").cast(pa.binary()).to_pylist()
            digest = pa.array([hashlib.sha256(line).digest()[:16] for line in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["of"], digest, column], ["of", "digest", "sketch"])

    return stored(rows.mapInArrow(sketch, "of struct<row:bigint,id:bigint>, digest binary, sketch binary").select(
        "of.*", "digest", "sketch"), "jaccard-prints")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Stored: one node per distinct word sequence: node, digest, first (least id), copies, sketch."""
    return stored(rows.filter("sketch IS NOT NULL").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("id").alias("first"), F.count("*").alias("copies"),
        F.min("sketch").alias("sketch")), "jaccard-nodes")


PATH_TYPE = "key bigint, node bigint"


def first_buckets(known: DataFrame, first: int = 0, runs: int = RUNS) -> DataFrame:
    """Stored: the nodes of every bucket of the first level (key, node) in the runs from `first` to before `runs`."""
    @giving_back
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, tokens = batch["node"].to_numpy(), matrix(batch["sketch"])
            for run in range(first, runs):
                row, path = drawn(tokens, np.full(len(node), run, np.uint64), DRAWN)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row])], ["key", "node"])

    return stored(known.mapInArrow(paths, PATH_TYPE), "jaccard-paths")


def with_sizes(paths: DataFrame) -> DataFrame:
    """Stored: the rows of buckets of more than one node, with its size `n`."""
    sizes = paths.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(paths.join(sizes.hint("merge"), "key"), "jaccard-buckets")


def all_links(docs: DataFrame, nodes: DataFrame, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Stored: rows (node, links, near) whose `links` add up to a node's number of verified links; rows with `near` are
    links that connect what all links connect."""
    known = nodes.select("node", "sketch")
    blocks = stored(partners(compared_buckets(known, depth), known), "jaccard-blocks")
    needed = nodes.select("node", "digest").join(blocks.select("node").distinct(), "node", "left_semi")
    return verified_blocks(blocks, exact_sets(docs, text_col, stored(needed, "jaccard-needed")))


def compared_buckets(known: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The nodes (key, node, n) of the buckets to compare, of all runs and levels."""
    met, done, runs, who = [], 0, RUNS, known
    while done < runs:
        rows, split, level = split_buckets(first_buckets(who, done, runs), who, depth)
        met += rows
        done, runs = runs, max(runs, runs_for(level))
        if done < runs:
            # nodes split in every round so far: a pair that was compared in no bucket shares only split ones
            who = stored(who.join(split.hint("merge"), "node", "left_semi"), "jaccard-again")
    return functools.reduce(DataFrame.union, met)


def split_buckets(paths: DataFrame, known: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Per level: the nodes (key, node, n) of buckets to compare. With them the nodes of buckets that were split at the
    first level, and the deepest level reached.

    A bucket of at most `PAIRS` comparisons is compared, as is one that its path does not split; the others go on.
    """
    met, split, rows = [], None, with_sizes(paths.withColumn("was", F.lit(None).cast("bigint")))
    for level in range(depth):
        now = F.coalesce(few_pairs() | (F.col("n") >= F.col("was") * SAME), F.lit(False)) | F.lit(level == depth - 1)
        met.append(rows.filter(now).select("key", "node", "n"))
        on = rows.filter(~now)
        if not on.head(1):
            break
        if split is None:
            split = stored(on.select("node").distinct(), "jaccard-split")
        rows = with_sizes(stored(on.join(known.hint("merge"), "node").mapInArrow(
            next_paths, PATH_TYPE + ", was bigint"), "jaccard-paths"))
    return met, split, level


def few_pairs() -> Column:
    return F.col("n") * (F.col("n") - 1) <= 2 * PAIRS


def partners(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates by blocks of buckets (key, node, n) in which all nodes meet; huge ones in pairs of chunks.

    A row carries the keys of its node's buckets before this one, so that a pair is a candidate in one bucket only.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("met")).join(
        known.hint("merge"), "node")
    dealt = met.select("node", "sketch", F.col("met.key").alias("keys"), F.posexplode("met").alias("at", "of")).select(
        "of.key", "of.n", "node", "sketch", F.slice("keys", F.lit(1), F.col("at")).alias("smaller"))
    chunks = F.when(few_pairs(), 1).otherwise(F.ceil(F.col("n") / CHUNK)).cast("int")
    dealt = once(dealt.withColumn("chunks", chunks), own=F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select(
        F.when(F.col("chunks") == 1, F.col("key")).otherwise(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"),
        "node", F.when(F.col("own") != F.col("other"), F.col("own") < F.col("other")).alias("seeker"), "smaller",
        "sketch").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(
        partners_of_buckets, "key bigint, node bigint, others array<bigint>")


def verified_blocks(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored: the links among the candidates of blocks, as numbers per node and block and as forests."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(blocks.join(sets.hint("merge"), "node").repartition(tasks, "key").sortWithinPartitions(
        "key").mapInArrow(links_of_blocks, "node bigint, links bigint, near bigint"), "jaccard-links")


def exact_sets(docs: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """Stored: node and sorted shingle set of the nodes in `needed` (node, digest).

    A filter of fixed size over the needed digests keeps other texts out of the shuffle.
    """
    bits = with_filter_place(needed.select(F.col("digest").alias("_xd_digest"))).groupBy("_xd_word").agg(
        F.bit_or("_xd_mask").alias("_xd_seen"))
    rows = docs.select(ascii_words(whole_text(text_col)).alias("words"))
    rows = rows.select(digest_of(F.col("words")).alias("_xd_digest"), "words")
    likely = possibly_repeated(with_filter_place(rows), stored(bits, "jaccard-filter")).filter("_xd_maybe").select(
        F.col("_xd_digest").alias("digest"), "words").withColumn(
        "salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    # of copies, one per salt remains before the one that stays is picked
    one = likely.groupBy("digest", "salt").agg(F.first("words").alias("words")).groupBy("digest").agg(
        F.first("words").alias("words"))

    @giving_back
    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in cut(batches):
            hashes, counts = shingles(batch["words"])
            owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
            at = np.lexsort((hashes, owner))
            hashes, owner = hashes[at], owner[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            sizes = np.bincount(owner[fresh], minlength=len(counts))
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                            pa.array(hashes[fresh].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["node"], sets], ["node", "shingles"])

    return stored(one.join(needed, "digest").select("node", "words").mapInArrow(
        to_sets, "node bigint, shingles array<bigint>"), "jaccard-sets")


def components(links: DataFrame, order: DataFrame) -> DataFrame:
    """Stored: node, label (the least `order` struct of its component). `order` has (node, label) of every node."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                   "jaccard-edges")
    labels = stored(order.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi"),
                    "jaccard-labels")
    while True:
        spread = edges.join(labels.hint("merge"), F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(
            F.min("label").alias("near"))
        closer = stored(labels.join(spread.hint("merge"), "node").select(
            "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")),
            "jaccard-labels")
        # jump: take over the label that the node of one's label has by now
        jumped = closer.select("node", "label", F.col("label.node").alias("to")).join(
            closer.select(F.col("node").alias("to"), F.col("label").alias("next")).hint("merge"), "to")
        labels = stored(jumped.select("node", F.least("label", "next").alias("label")), "jaccard-labels")
        if not closer.filter("moved").head(1):
            return labels


def classes_of_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with words: id, digest, class_id, stays, n_links, n_copies; and the ids of the rows without.

    `stays` marks the rows that represent their class: those with its least id and the words of its first node.
    """
    rows = prints(docs, id_col, text_col)
    nodes = nodes_of(rows)
    links = all_links(docs, nodes, text_col)
    order = nodes.select("node", F.struct(F.coalesce("first", F.lit(LAST)).alias("first"), "node").alias("label"))
    labels = components(links.filter("near IS NOT NULL").select(F.col("node").alias("a"), F.col("near").alias("b")), order)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    own = F.struct(F.coalesce("first", F.lit(LAST)).alias("first"), "node")
    classes = nodes.select("node", "digest", "first", "copies").join(labels, "node", "left").join(
        degree, "node", "left").select(
        "digest", "node", F.coalesce("label", own).alias("label"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.col("copies").alias("n_copies"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    least = F.col("label.first")
    worded = rows.filter("sketch IS NOT NULL").select(
        "id", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).join(
        classes, ["digest", "salt"]).select(
        "id", "digest", F.when(least != LAST, least).alias("class_id"),
        ((F.col("label.node") == F.col("node")) & (F.coalesce("id", F.lit(LAST)) == least)).alias("stays"),
        "n_links", "n_copies")
    return worded, rows.filter("sketch IS NULL").select("id")


def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (least id of the class), n_links (links to other texts), n_copies (rows with these words)."""
    worded, empty = classes_of_rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    alone = empty.select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
                         F.lit(1).cast("bigint").alias("n_copies"))
    return worded.select("id", "class_id", "n_links", "n_copies").unionByName(alone).select(
        F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: one with the least id of the class and the words of that row.

    What goes is decided by id and words together, so a row that shares its id with a copy stays if its own words have
    no partner. Rows without words stay. The ids of rows that go or repeat are put into a filter of fixed size; rows
    outside it pass without a shuffle and without a look at their words.
    """
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    worded, _ = classes_of_rows(docs, id_col, text_col)
    decided = stored(worded.groupBy(name.alias("_xd_id"), F.col("digest").alias("_xd_words")).agg(
        F.max("stays").alias("_xd_stays"), F.count("*").alias("_xd_n")).filter("NOT _xd_stays OR _xd_n > 1"),
        "jaccard-decided")
    ids = decided.select(F.col("_xd_id").cast("binary").alias("_xd_digest"))
    bits = stored(with_filter_place(ids).groupBy("_xd_word").agg(F.bit_or("_xd_mask").alias("_xd_seen")),
                  "jaccard-filter")
    placed = with_filter_place(docs.withColumn(
        "_xd_digest", F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    looked = possibly_repeated(placed, bits)
    words = digest_of(ascii_words(whole_text(text_col)))
    keys = ["_xd_id", "_xd_words"]
    maybe = looked.filter("_xd_maybe").select(*docs.columns, F.col("_xd_digest").cast("string").alias("_xd_id"),
                                              words.alias("_xd_words")).join(decided, keys, "left")
    free = maybe.filter("_xd_stays IS NULL").select(*docs.columns)
    first = maybe.filter("_xd_stays").dropDuplicates(keys).select(*docs.columns)
    return looked.filter(~F.col("_xd_maybe")).select(*docs.columns).unionByName(free).unionByName(first)
