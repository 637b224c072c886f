"""Operators over whole corpora against plain Python: copies, passages, similarity, mixing, archives, pipeline."""

import collections
import hashlib
import itertools
import io
import random
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, jaccard, mixing, substring, warc


def key(row):
    return tuple(map(str, row))


# ------------------------------------------------------------------ exact copies

COPIES = [(1, "Ab"), (2, "aB"), (2, "aB"), (None, "AB"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "only"),
          (7, "x" * 200_000), (8, "X" * 200_000)]


def test_exact_copies(table):
    got = exact_dedup.duplicate_report(table(COPIES)).collect()
    groups = collections.Counter((r.keep_id, r.group_size) for r in got)
    assert groups == {(2, 4): 4, (4, 2): 2, (5, 1): 1, (6, 1): 1, (None, 1): 1, (8, 2): 2}
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(map(str, kept)) == ["2", "4", "5", "6", "8", "None"]
    assert {r.text_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"ab").hexdigest()}
    assert exact_dedup.duplicate_report(table([], name="none")).count() == 0


def test_kept_rows_carry_all_columns(table):
    docs = table(COPIES)
    got = exact_dedup.drop_equal_texts(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "4", "5", "6", "8", "None"]


# ------------------------------------------------------------------ passages

def without_repeats(rows, words, window=20):
    seen, out = set(), []
    for _, (i, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            if k in seen:
                gone[a:a + window] = [True] * window
            seen.add(k)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def removed(docs):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()]


A, B = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 30), ("v", 25)))
PASSAGES = [(5, A), (3, f"{B} {A}"), (3, f"{B} {A}"), (None, A), (None, None), (7, ""), (8, "  \n "), (9, "x " * 60),
            (10, f"{A}\n{B}\t{A}"), (2, f"é {B}"), (11, "long " * 30_000)]


def test_repeated_passages(table, words):
    assert sorted(removed(table(PASSAGES)), key=key) == sorted(without_repeats(PASSAGES, words), key=key)
    assert removed(table([], name="none")) == []


def test_repeated_passages_over_many_blocks(spark, tmp_path, words, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_SUFFIXES", 500)  # so that prefixes become heavy and split
    pool = random.Random(3)
    base = [" ".join(pool.choice("a b c d e f g".split()) for _ in range(pool.randint(0, 90))) for _ in range(12)]
    rows = [(i, " ".join(pool.sample(base, 3))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(removed(docs), key=key) == sorted(without_repeats(rows, words), key=key)


def test_passages_of_documents(small_docs, words):
    rows = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    assert sorted(removed(small_docs), key=key) == sorted(without_repeats(rows, words), key=key)


def test_spans_name_the_removed_words(table, words):
    for r in substring.remove_repeats(table(PASSAGES)).collect():
        assert sum(s.length for s in r.spans) == r.n_removed


# ------------------------------------------------------------------ similarity join

def classes(rows, words):
    texts = {}
    for i, text in rows:
        w = tuple(words(text))
        texts.setdefault(w, set()).update([w[a:a + 5] for a in range(max(1, len(w) - 4))] if w else [])
    nodes = list(texts)
    parent, links = list(range(len(nodes))), collections.Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(nodes)):
        for b in range(a):
            x, y = texts[nodes[a]], texts[nodes[b]]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    place, best = {n: k for k, n in enumerate(nodes)}, {}
    for i, text in rows:
        root = find(place[tuple(words(text))])
        best[root] = min(best.get(root, float("inf")), float("inf") if i is None else i)
    return links, place, find, best


def test_join_equals_brute_force(table, words):
    pool = random.Random(7)
    rows, number = [(None, "a b c d e f g"), (900, "a b c d e f g"), (901, "one two"), (902, "one two"), (903, None),
                    (904, ""), (905, None), (906, "huge " * 20_000)], 0
    for _ in range(25):
        base = [f"w{pool.randrange(3000)}" for _ in range(pool.randint(30, 120))]
        for _ in range(pool.randint(1, 8)):
            copy = list(base)
            for _ in range(pool.randint(0, 4)):
                copy[pool.randrange(len(copy))] = f"z{pool.randrange(9999)}"
            rows.append((number, " ".join(copy)))
            number += 1
    got = {}
    for r in jaccard.join_report(table(rows)).collect():
        got[r.doc_id] = r
    links, place, find, best = classes([r for r in rows if words(r[1])], words)
    for i, text in rows:
        if words(text):
            node = place[tuple(words(text))]
            least = best[find(node)]
            assert (got[i].class_id, got[i].n_links) == (None if least == float("inf") else least, links[node])
        elif i is not None:
            assert (got[i].class_id, got[i].n_links) == (i, 0)


def test_large_group_of_near_copies_is_one_class(table, monkeypatch):
    pool = random.Random(9)
    monkeypatch.setattr(jaccard, "BRUTE", 16)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[pool.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    rows.append((150, "something else altogether that is not like the rest"))
    got = {r.doc_id: r.class_id for r in jaccard.join_report(table(rows)).collect()}
    assert {got[i] for i in range(150)} == {0} and got[150] == 150
    kept = jaccard.one_of_each(table(rows, name="again"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 150]


def test_seeker_keeps_all_its_candidates():
    tokens = np.arange(64, dtype=np.uint32)
    table = pa.table({"key": pa.array([5] * 12, pa.int64()), "node": pa.array(range(12), pa.int64()),
                      "sketch": pa.array([tokens.tobytes()] * 11 + [(tokens + 100).tobytes()], pa.binary()),
                      "seeker": [True] + [False] * 11})
    assert sum(len(b) for _, b in jaccard.bucket_pairs(table)) == 10


def test_pair_is_a_candidate_in_its_first_bucket_only(monkeypatch):
    """Five equal sketches in three buckets, packed as small buckets or compared as large ones."""
    member = {1: [10, 11, 12, 13], 2: [10, 11, 14], 3: [10, 12, 13, 14]}
    rows = [(key, node, [k for k in member if k < key and node in member[k]]) for key in member for node in member[key]]
    table = pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "node": pa.array([r[1] for r in rows], pa.int64()),
                      "smaller": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                      "sketch": pa.array([np.arange(64, dtype=np.uint32).tobytes()] * len(rows), pa.binary())})
    want = sorted({pair for nodes in member.values() for pair in itertools.combinations(nodes, 2)})
    for brute in (128, 1):
        monkeypatch.setattr(jaccard, "BRUTE", brute)
        got = [(r["node"], other) for batch in jaccard.partners_of_buckets(iter(table.to_batches()))
               for r in batch.to_pylist() for other in r["others"]]
        assert sorted(got) == want


def near_copies(pool, base, count, mark, changes=1):
    out = []
    for i in range(count):
        copy = list(base)
        for k in pool.sample(range(len(base)), changes):
            copy[k] = f"{mark}{i}x{k}"
        out.append(" ".join(copy))
    return out


def test_links_of_large_groups_are_complete(table, words, monkeypatch):
    pool = random.Random(4)
    monkeypatch.setattr(jaccard, "BRUTE", 16)
    base = [f"w{k}" for k in range(100)]
    texts = near_copies(pool, base, 60, "z")
    # a chain that leaves the group: each step is linked to its neighbours only
    for step in range(1, 9):
        texts.append(" ".join(f"s{k}" if k < 4 * step else w for k, w in enumerate(base)))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_report(table(rows)).collect()}
    links, place, find, best = classes(rows, words)
    assert got == {i: (best[find(k)], links[k]) for i, t in rows for k in [place[tuple(words(t))]]}


def test_chunks_and_levels_of_large_buckets_lose_no_link(table, words, monkeypatch):
    for name, value in {"BRUTE": 8, "PAIRS": 200, "CHUNK": 16, "BLOCK": 8}.items():
        monkeypatch.setattr(jaccard, name, value)
    pool = random.Random(5)
    rows = list(enumerate(near_copies(pool, [f"w{k}" for k in range(150)], 70, "z")))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_report(table(rows)).collect()}
    links, place, find, best = classes(rows, words)
    assert got == {i: (best[find(k)], links[k]) for i, t in rows for k in [place[tuple(words(t))]]}


def test_runs_meet_the_stated_miss():
    assert jaccard.runs_for(0) == jaccard.RUNS and [jaccard.runs_for(k) for k in (1, 2, 5)] == [10, 13, 22]


def test_recall_of_pairs_in_split_buckets(table, monkeypatch):
    """600 documents share a passage; two each are near pairs (93 of 115 shingles), all others are not (84 of 124)."""
    monkeypatch.setattr(jaccard, "PAIRS", 1 << 14)  # so that the passage's buckets are split as often as can be
    monkeypatch.setattr(jaccard, "SAME", 2.0)
    rounds, buckets = [], jaccard.first_buckets

    def noted(known, first=0, runs=jaccard.RUNS):
        rounds.append(runs)
        return buckets(known, *((first, runs) if first else ()))

    monkeypatch.setattr(jaccard, "first_buckets", noted)
    passage, rows = " ".join(f"p{k}" for k in range(88)), []
    for i in range(600):
        shared, own = (" ".join(f"{name}x{k}" for k in range(n)) for name, n in ((f"s{i // 2}", 9), (f"o{i}", 11)))
        rows.append((i, f"{passage} {shared} {own}"))
    got = jaccard.join_report(table(rows)).collect()
    assert all(r.n_links <= 1 and r.class_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got)
    assert rounds[-1] >= jaccard.runs_for(2) > jaccard.RUNS
    # the bound on the estimate from the tokens misses about 0.2 %
    assert sum(r.n_links for r in got) >= 0.985 * 600


def test_join_of_empty_table(table):
    assert jaccard.join_report(table([])).count() == 0


# ------------------------------------------------------------------ mixing

SOURCES = [(i, "w " * n, s) for i, (n, s) in enumerate(
    [(400, "a"), (300, "a"), (5, "b"), (7, "b"), (90, "c"), (0, "c"), (60, None), (3000, "d"), (1, "e")])]


def test_mix_meets_targets(table):
    docs = table([*SOURCES, (None, None, "a"), (3, "w " * 7, "b")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    total, taken, target, size = sum(r.size for r in rows), collections.Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 3 * r.size
    assert len(rows) == 11 and abs(sum(target.values()) - total) < 1e-6
    for source in target:
        assert abs(taken[source] - target[source]) <= 0.5 and target[source] <= 3 * size[source]
    again = sorted(map(key, mixing.mix(docs).collect()))
    assert again == sorted(map(key, rows))


def test_mix_of_empty_and_wordless_tables(table):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(table([], schema)).count() == 0
    got = mixing.mix(table([(1, "", "a"), (2, None, None)], schema, name="w")).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0), (0, 0)]


def test_mixed_rows_repeat_documents(table):
    docs = table(SOURCES, "doc_id long, text string, source string")
    got = mixing.mixed_rows(docs)
    times = collections.Counter(r.doc_id for r in got.collect())
    for r in mixing.mix(docs).collect():
        assert abs(times[r.doc_id] * r.size - r.taken) <= r.size / 2
    assert got.columns == docs.columns


def test_schedule_is_even_in_every_prefix(spark):
    docs = spark.createDataFrame([(i, "w " * 2000, "abc"[i % 3]) for i in range(30)],
                                 "doc_id long, text string, source string")
    sums = mixing.sized(docs).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = mixing.source_targets(sums).cache()
    ranks = mixing.ranked_slots(targets).groupBy("place").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    got = {r.place: r for r in ranks.collect()}
    share = {r.place: r.draws for r in targets.collect()}
    total = sum(r.n for r in got.values())
    assert all(r.last == r.n - 1 for r in got.values())
    assert all(abs(got[p].n - total * t / sum(share.values())) < 8 for p, t in share.items())


# ------------------------------------------------------------------ archives

PAGES = [(3, "http://a/é x", "<p>" + "x" * 200), (1, "http://b", "<p>" + "x" * 200), (2, None, "short"),
         (4, "u", "short"), (5, "u", None), (None, "u", "<p>" + "x" * 200), (6, "u", "é" * 50_000), (6, "u", "\r\n\r\n")]


def test_pages_through_archives(table):
    got = warc.round_trip(table(PAGES, "page_id long, url string, html string")).collect()
    assert len(got) == len(PAGES)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds[(1, "response", None, 203)] == kinds[(3, "revisit", 1, 203)] == kinds[(None, "revisit", 1, 203)] == 1
    assert kinds[(2, "response", None, 5)] == kinds[(4, "response", None, 5)] == kinds[(5, "response", None, 0)] == 1
    digests = {(r.page_id, r.payload_bytes): r.payload_digest for r in got}
    for page, _, html in PAGES:
        data = (html or "").encode()
        assert digests[page, len(data)] == hashlib.sha256(data).hexdigest()
    assert warc.round_trip(table([], "page_id long, url string, html string", name="none")).count() == 0


def zip64_of(name, data):
    """A package whose central directory moves every value to ZIP64 fields."""
    local = struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0, 0, 0, 0, 0, len(data), len(data), len(name), 0) + name + data
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra),
                        0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sLQL", b"PK\6\7", 0, len(local) + len(entry), 1)
    end = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    return local + entry + end64 + locator + end


def test_central_directories():
    data = zip64_of(b"archive/data.warc.gz", b"0123456789")
    members = warc.central_directory(io.BytesIO(data), len(data))
    at, size = warc.stored_member(io.BytesIO(data), members, warc.DATA)
    assert data[at:at + size] == b"0123456789"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"0" * 100)
    members = warc.central_directory(plain, len(plain.getvalue()))
    with pytest.raises(ValueError, match="compressed"):
        warc.stored_member(plain, members, warc.DATA)
    with pytest.raises(ValueError, match="no ZIP"):
        warc.central_directory(io.BytesIO(b"x" * 50), 50)


def test_ranges_cover_all_records(monkeypatch):
    out = io.BytesIO()
    records = [(str(i), warc.write_record(i, "u", b"x" * i, i, "d", None)) for i in range(50)]
    assert warc.package(out, iter(records))[0] == 50
    data = out.getvalue()
    runs = list(warc.index_ranges(io.BytesIO(data), len(data), most=900))
    assert len(runs) > 3 and sum(len(n) for _, n in runs) == 50
    import zlib

    at, lengths = runs[1]
    fields, payload = warc.read_record(zlib.decompress(data[at:at + lengths[0]], 31))
    assert payload == b"x" * int(fields["warc-payload-length"])


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, table, words):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    en, de = "the cat and the dog of the house in that street with this", "der Hund und die Katze aus dem Haus mit"
    rows = [(i, f"{en} " * 4 + " ".join(f"the{chr(97 + i)}{k} and" for k in "abcdefgh"), "en", "a", 1)
            for i in range(8)]
    rows += [(20 + i, f"{de} " * 6 + " ".join(f"die{chr(97 + i)}{k} und" for k in "abcdefgh"), "de", "b", 1)
             for i in range(8)]
    rows += [(40, rows[0][1].upper(), "en", "a", 1), (41, None, None, None, None), (42, "123", "en", "b", 3)]
    docs, ids, stage_taken = table(rows, schema), [], []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, "unused")
        if name == "mixing":
            stage_taken = [(r.doc_id, r.taken / max(r.size, 1)) for r in mixing.mix(docs).collect()]
        if n < 4:
            assert got.columns == docs.columns, name
        docs = table(got.collect(), got.schema, extra=(), name=f"s{n}")
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] == {r[0] for r in rows} - {41, 42}
    assert ids[1] == ids[0] - {0}  # of equal texts the largest id stays
    assert ids[2] == similar_kept([(r[0], r[1]) for r in rows if r[0] in ids[1]], words)
    taken = {i: n for i, n in stage_taken if n >= 0.5}
    assert ids[3] == ids[4] == set(taken)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table([], schema, extra=(), name=f"e{stage.__name__}"), "unused").count() == 0


def similar_kept(rows, words):
    """Ids that stay if of every class of similar texts only the least id does."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return set(least.values())


def test_one_of_each_decides_by_id_and_words(table):
    base = [f"w{k}" for k in range(100)]
    near = lambda k: " ".join(base[:k] + [f"x{k}"] + base[k + 1:])
    other = "quite another text that nothing here is like at all"
    rows = [(3, " ".join(base)), (None, near(20)), (5, near(60)), (5, other), (3, " ".join(base)), (None, None), (9, ""),
            (7, other + " really no"), (None, "text of a row without an id")]
    kept = sorted(((str(r.doc_id), r.text) for r in jaccard.one_of_each(table(rows)).collect()), key=str)
    want = [(3, " ".join(base)), (5, other), (None, None), (9, ""), (7, other + " really no"),
            (None, "text of a row without an id")]
    assert kept == sorted(((str(i), t) for i, t in want), key=str)


def test_pipeline_keeps_documents_if_no_language_was_learned(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "some words", None, "a", 1), (2, "123 456", None, "a", 1), (3, None, None, None, None)]
    got = corpus_pipeline.known_language(spark, table(rows, schema), "unused").collect()
    assert [r.doc_id for r in got] == [1]


def test_pipeline_carries_null_and_repeated_ids(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    body = lambda k: " ".join(f"the word{k}{c} and" for c in "abcdefghij")
    rows = [(k, body(k), "en", "a", 1) for k in range(12)] + [(4, body(50), "en", "a", 1), (None, body(51), "en", None, 1),
                                                            (None, body(52), "en", "a", 1)]
    docs = table(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, "unused")
        docs = table(got.collect(), got.schema, extra=(), name=name)
        assert sorted(str(r.text) for r in docs.collect()) == sorted(r[1] for r in rows), name
