"""Periodic runs, bin packing and token alignment against plain Python."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import alignment, packing, periodic
from tidemark.llm.common import stored

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
MODEL, PATTERN = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
EMPTY = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [(1, "a  b<|endoftext|> c <|endoftext|>"), (2, None), (3, ""), (4, "Ⱟᾝ6 xࡰy  \n\n z ٣ ²½ ▁ <0x41> </s>"),
       (None, "null id"), (5, "don't  'll we'RE \t\n x\r\n"), (6, "long words " * 9_000), (7, " " * 300 + "a"),
       (8, "\x00\x01 ab \x85\xa0"), (8, "\x00\x01 ab \x85\xa0"), (9, "一二三 تجربة नमस्ते 😀😀"), (10, "<|endoftext|>"),
       (11, "a b c " * 20 + "x " + "q " * 30 + "end"), (20, "one two three four " * 40), (30, "aaaa aaa aa a " * 9)]


# ------------------------------------------------------------------------------------- periodic runs

def runs_of(w, least=24, times=3):
    """All runs by comparing words one period apart, for every period."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                u = w[i:i + size]
                if not any(u[d:] == u[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(i, w):
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def expected_runs(i, text, words):
    w = looped(i, words(text))
    runs = runs_of(w)
    best = max(runs, key=lambda r: (r[1] * (1 << 80) // r[2], -r[0], -r[2])) if runs else (None,) * 3
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_runs_equal_brute_force(table, words):
    rnd = random.Random(11)
    rows = list(ODD)
    for i in range(100, 400):
        w = []
        for _ in range(rnd.randint(1, 6)):
            part = [rnd.choice("ab" if rnd.random() < 0.4 else "abcdefgh") for _ in range(rnd.randint(1, 14))]
            w += part * rnd.choice([1, 1, 2, 3, 5, 9])
        rows.append((i, " ".join(w)))
    got = collections.Counter(tuple(r) for r in periodic.run_report(table(rows)).collect())
    assert got == collections.Counter(expected_runs(i, t, words) for i, t in rows)


def test_runs_of_documents_equal_brute_force(small_docs, words):
    docs = small_docs.where("length(text) < 4000")
    got = {r.doc_id: tuple(r) for r in periodic.run_report(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: expected_runs(r.doc_id, r.text, words) for r in rows}
    assert sum(r[1] for r in got.values()) > 10


def test_squares_are_all_found():
    rnd = random.Random(5)
    for _ in range(300):
        w = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 40))]
        want = {(e, h) for e in range(len(w) + 1) for h in range(1, e // 2 + 1) if w[e - h:e] == w[e - 2 * h:e - h]
                and not any(h % d == 0 and w[e - h:e] == w[e - d:e] * (h // d) for d in range(1, h))}
        assert set(periodic.squares(w)) == want


def test_stretches_leave_out_no_run():
    """Documents in one block, runs at their borders, equal words across them."""
    rnd = random.Random(7)
    for _ in range(200):
        docs = [[rnd.randrange(2) for _ in range(rnd.randint(0, 5))] * rnd.randint(1, 20) for _ in range(4)]
        lengths = np.array([len(d) for d in docs])
        flat = [w for d in docs for w in d]
        hashes = np.array(flat, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)
        got, first = set(), np.cumsum(lengths) - lengths
        for begin, end in zip(*(x.tolist() for x in periodic.repeated_stretches(hashes, lengths))):
            got |= {(begin + s, n, q) for s, n, q in periodic.stretch_runs(flat[begin:end])}
        assert got == {(int(first[i]) + s, n, q) for i, d in enumerate(docs) for s, n, q in runs_of(d)}


def test_runs_keep_general_outputs(table):
    rows = [(1, "x " + "a b " * 14 + "y"), (2, None)]
    got = {r.doc_id: r for r in periodic.collapse_runs(table(rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 28, 2)] and got[1].collapsed == "x a b y"
    assert got[2].runs == [] and got[2].collapsed == ""


def test_sequence_operators_of_an_empty_table(table):
    empty = table([], EMPTY)
    assert periodic.run_report(empty).collect() == []
    assert packing.packed_documents(empty, RANKS, PATTERN).collect() == []
    assert alignment.alignment_report(empty, RANKS, PATTERN, MODEL).collect() == []


# ----------------------------------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def check_packing(rows, docs, library):
    """Pieces cover every document, sequences are gapless and within the capacity; returns their number."""
    tokens = collections.defaultdict(list)
    for i, text in docs:
        tokens[i].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(tokens)
    for i, copies in tokens.items():
        want = collections.Counter()
        for ids in copies:
            cut = (len(ids) - 1) % 1024 + 1
            edges = [0, *range(cut, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                want[(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
        assert collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_packing_of_odd_texts(table, library):
    rows = packing.packed_documents(table(ODD), RANKS, PATTERN).collect()
    check_packing(rows, ODD, library)


def test_packing_of_documents_needs_the_least_sequences(small_docs, library):
    rows = packing.packed_documents(small_docs, RANKS, PATTERN).collect()
    docs = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    n = check_packing(rows, docs, library)
    total, large = sum(r.length for r in rows), sum(2 * r.length > 1024 for r in rows)
    assert n <= max(-(-total // 1024), large) + 2


def test_fullest_combination_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        got = packing.fullest(counts, room)
        assert all(k <= counts[length] for length, k in got)
        assert sum(length * k for length, k in got) == max(sums)


def test_plan_uses_every_piece_once():
    rnd = random.Random(4)
    for _ in range(60):
        counts = collections.Counter(rnd.randint(1, 40) for _ in range(rnd.randint(0, 400)))
        bins = packing.plan_bins(dict(counts), 40)
        used = collections.Counter()
        for b in bins:
            assert sum(length * n for length, n in b.filling) <= 40
            for length, n in b.filling:
                used[length] += n * b.times
        assert used == counts
        places, seen = packing.plan_places(bins), set()
        for length, n in counts.items():
            sequence, offset = packing.placed(places, np.full(n, length), np.arange(n))
            cells = {(s, o + k) for s, o in zip(sequence.tolist(), offset.tolist()) for k in range(length)}
            assert len(cells) == n * length and not cells & seen
            seen |= cells


def test_sequences_hold_their_pieces(table, library):
    docs = [(i, t) for i, t in ODD if i is not None and i != 8]
    cut = stored(packing.pieces(table(docs), RANKS, PATTERN, with_ids=True), "pieces")
    rows = packing.sequences(packing.pack(cut)).collect()
    assert all(len(r.ids) <= 1024 for r in rows)
    joined = collections.defaultdict(dict)
    starts = {(r.sequence_id, r.offset): (r.doc_id, r.piece, r.length) for r in packing.pack(cut).collect()}
    for r in rows:
        for part in r.pieces:
            i, piece, length = starts[(r.sequence_id, part.offset)]
            assert i == part.id
            joined[i][piece] = r.ids[part.offset:part.offset + length]
    for i, text in docs:
        ids = [x for k in sorted(joined[i]) for x in joined[i][k]]
        assert ids == library.encode(text or "", add_special_tokens=False).ids + [2]


# --------------------------------------------------------------------------------------- alignment

def aligned_brute(docs):
    """Groups, links and counts of a corpus with the libraries and nested loops over overlapping tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte = {chr(b): b for b in shown} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def b_bytes(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    out, holders = [], collections.Counter()
    for i, text in docs:
        whole = b" " + (text or "").encode()
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        pieces_a = [bytes(byte[c] for c in plain.id_to_token(x)) for x in a]
        pieces_b = [b_bytes(x) for x in b]
        if not text or b"".join(pieces_a) != whole or b"".join(pieces_b) != whole:
            out.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in pieces_a]).tolist(), np.cumsum([len(p) for p in pieces_b]).tolist()
        groups, links, x, y = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append((a[x:u], b[y:v]))
            for m in range(x, u):
                for n in range(y, v):
                    if max(ends_a[m] - len(pieces_a[m]), ends_b[n] - len(pieces_b[n])) < min(ends_a[m], ends_b[n]):
                        links.append((a[m], b[n]))
            x, y = u, v
        out.append((i, a, b, groups, links))
        holders.update(set(links))
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for i, a, b, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((i, len(a), len(b), len(groups), len(links), sum(holders[x] == best[x[0]] for x in links),
                     sum(holders[x] for x in links), sha(text) if a else ""))
    return rows, holders


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 400])
def test_alignment_equals_brute_force(table, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    docs = [(i, t if i != 6 else "long words " * 300) for i, t in ODD]
    docs += [(40, "internationalization of tokenizers"), (41, " leading"), (42, "ﬁ ligature"), (43, "internationalisation")]
    got = collections.Counter(tuple(r) for r in alignment.alignment_report(table(docs), RANKS, PATTERN, MODEL).collect())
    assert got == collections.Counter(aligned_brute(docs)[0])


def test_alignment_of_documents_equals_brute_force(spark, small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    frame = small_docs.where("length(text) < 3000 or text is null")
    want, holders = aligned_brute(docs)
    got = [tuple(r) for r in alignment.alignment_report(frame, RANKS, PATTERN, MODEL).collect()]
    assert sorted(got) == sorted(want)
    blocks = stored(alignment.blocks_of(frame, RANKS, PATTERN, MODEL), "aligned")
    a, b, same = alignment.vocabularies(RANKS, PATTERN, MODEL)
    counted = alignment.pair_counts(blocks, same, len(b.sizes)).collect()
    assert {(r.a_id, r.b_id): r.docs for r in counted} == dict(holders)


def test_token_groups(table):
    rows = alignment.token_groups(table([(1, "internationalization"), (2, None)]), RANKS, PATTERN, MODEL).collect()
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in rows}
    a, b, _ = alignment.vocabularies(RANKS, PATTERN, MODEL)
    assert got[2] == [] and all(
        b"".join(a.pieces[i].as_py() for i in x) == b"".join(b.pieces[i].as_py() for i in y) for x, y in got[1])
    assert b"".join(a.pieces[i].as_py() for x, _ in got[1] for i in x) == b" internationalization"
