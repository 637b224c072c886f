"""Operators on single texts against plain Python: secrets, tokens, BPE, language, quality."""

import collections
import hashlib
import os
import zlib

import public_tokenizers
import pytest

from tidemark.llm import bpe, langid, quality, secrets, token_counts
from tidemark.llm.common import giving_back

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


ODD = [(1, "a  b<|endoftext|> c <|endoftext|>"), (2, None), (3, ""), (4, "Ⱟᾝ6 xࡰy  \n\n z ٣ ²½"), (None, "null id"),
       (5, "don't  'll we'RE \t\n x\r\n"), (6, "long " * 40_000), (7, " " * 3000 + "a"), (8, "\x00\x01 ab \x85\xa0"),
       (8, "\x00\x01 ab \x85\xa0"), (9, "一二三 تجربة नमस्ते 😀😀"), (10, "<|endoftext|>"), (11, "<|endo ftext|>")]


def encoded(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(table, library):
    got = sorted(map(str, [tuple(r) for r in bpe.digests(table(ODD), JSON).collect()]))
    want = []
    for i, text in ODD:
        ids, back = encoded(library, text)
        want.append(str((i, len(ids), sha(",".join(map(str, ids))), sha(back))))
    assert got == sorted(want)


def test_bpe_round_trip_of_documents(small_docs):
    rows = bpe.decode(bpe.encode(small_docs, JSON), JSON).join(small_docs, "doc_id").selectExpr(
        "count(*) AS n", "count_if(decoded = text) AS same").first()
    assert rows.n == rows.same == small_docs.count()


def test_token_counts_equal_the_library(table, small_docs, library):
    for docs in (table(ODD), small_docs):
        got = collections.Counter(tuple(r) for r in token_counts.token_counts(
            docs, RANKS, public_tokenizers.PATTERN).collect())
        want = collections.Counter()
        for i, text in docs.select("doc_id", "text").collect():
            n = len(encoded(library, text)[0])
            want[(i, len((text or "").encode()), n, n > 1024)] += 1
        assert got == want


def test_safe_parts_keep_counts(library):
    text = "word's  two\n\nthree 4,5 " * 300 + "x" * 500 + " tail"
    parts = token_counts.safe_parts(text, long=100)
    assert "".join(parts) == text and len(parts) > 10
    assert sum(len(encoded(library, p)[0]) for p in parts) == len(encoded(library, text)[0])


def checked_token(body="A" * 30):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    return "ghp_" + body + digits.rjust(6, "0")


def test_secrets():
    good = checked_token()
    spans = lambda t: [f"{k}:{a}:{b}" for a, k, b in secrets.find_secrets(t)]
    assert spans("é PassWord = 'hunter22x'") == ["assign:2:23"]
    assert spans("secret: token: abcdefghijk") == []  # the first match takes `token` as its value and fails
    assert spans("token=secret=abcdefgh12") == ["assign:0:23"]
    assert spans("apikey=short") == [] and spans("API_KEY:longenough") == ["assign:0:18"]
    assert spans("AKIA" + "A" * 11) == [] and spans("xAKIA" + "A" * 12) == ["access:1:17"]
    assert spans("AKIAAKIAAKIAAKIA") == ["access:0:16"]
    assert spans("f" * 31) == [] and spans("g" + "f" * 33 + "F") == ["hex:1:34"]
    assert spans(good) == [f"checked:0:{len(good)}"] and spans(good[:-1] + "_") == []
    assert spans("İ token=abcdefgh") == ["assign:2:16"]  # a letter that grows in lower case
    assert spans("ſecret=abcdefgh") == []
    header = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert spans(header) == [f"jwt:0:{len(header)}"] and spans(header.replace("hbGci", "xxxxx")) == []


def test_secret_scan_rows(table):
    rows = [(1, None), (2, ""), (None, "token=abcdefgh1"), (3, "token=abcdefgh1"), (3, "token=abcdefgh1")]
    got = secrets.scan(table(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"]
    assert {r.base_sha256 for r in got if r.doc_id in (1, 2)} == {sha("")}
    assert {(r.n_assign, r.spans) for r in got if r.doc_id == 3} == {(1, "assign:0:15")}
    assert secrets.scan(table([], name="none")).count() == 0


def plain_base(text):
    """Base spans by expressions over the whole text, without keywords."""
    import re

    assign = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), k, m.end()) for k, expression, least in (
        (0, assign, 8), (1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32))
        for m in re.finditer(expression, text, re.ASCII) if len(m[2] if k == 0 else m[0]) >= least]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_of_documents_equal_plain_expressions(small_docs):
    got = {r.doc_id: r for r in secrets.scan(small_docs).collect()}
    for i, text in small_docs.select("doc_id", "text").collect():
        want = plain_base(text or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(
            sum(k == kind for k, _, _ in want) for kind in secrets.BASE)
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))


@pytest.mark.parametrize("part", ["eyJ", "eyJa.", "eyj", "token", "token=", "AKIA", "ghp_", "-----BEGIN ", "eyJa.eyJb"])
def test_secrets_in_very_long_texts_take_linear_time(part):
    import time

    start = time.perf_counter()
    secrets.find_secrets(part * (2_000_000 // len(part)))
    assert time.perf_counter() - start < 10


def test_failed_web_token_hides_no_later_one():
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    for before in ("eyJx ", "EYJ ", "eyJx.", "eyJx.eyJy "):
        span = (len(before), "jwt", len(before + token))
        assert secrets.find_secrets(before + token) == [span]


def test_token_counts_of_an_empty_table(table):
    assert token_counts.token_counts(table([], name="none"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_base_counts_equal_brute_force(small_docs, words):
    labels = small_docs.sparkSession.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ratios = quality.bucket_ratios(small_docs, quality.trusted_ids(labels))
    got = {r.doc_id: r for r in quality.judge(small_docs, ratios).collect()}
    for i, text in small_docs.select("doc_id", "text").collect():
        w, lines, seen = words(text), 0, set()
        for line in text.split("\n"):
            if words(line):
                lines += line in seen
                seen.add(line)
        found = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {a + k for a in range(len(w) - 2) if found[w[a], w[a + 1], w[a + 2]] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words,
                got[i].base_failed) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), lines,
                                        len(cover), failed)
        assert not (got[i].kept and failed)


def test_quality_verdict_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, quality.bucket_ratios(docs, quality.trusted_ids(labels))).join(labels, "doc_id")
    wrong = got.filter("(quality = 0 AND kept) OR (quality = 1 AND NOT base_failed AND NOT kept)").count()
    assert wrong == 0


def test_verdict_equals_plain_sums(small_docs):
    import math

    labels = small_docs.sparkSession.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    rows = small_docs.selectExpr("doc_id", "coalesce(text, '') AS text").select(
        "doc_id", quality.ngram_buckets(quality.F.col("text")).alias("grams")).collect()
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(r.grams)
        target.update(r.grams if r.doc_id in trusted else ())
    n, t = raw.total(), target.total()
    ratio = {b: round(1000 * math.log((target[b] + quality.PRIOR * t * raw[b] / n) / ((1 + quality.PRIOR) * t * raw[b] / n)))
             for b in raw}
    got = {r.doc_id: r for r in quality.judge(
        small_docs, quality.bucket_ratios(small_docs, quality.trusted_ids(labels))).collect()}
    for r in rows:
        score = sum(ratio[b] for b in r.grams) / (1000 * len(r.grams)) if r.grams else 0.0
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-12)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and got[r.doc_id].score >= quality.THRESHOLD)


def test_scores_do_not_depend_on_the_size_of_the_table(small_docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    far = 1_000_000
    copies = spark.range(20).withColumnRenamed("id", "copy")
    many, more = (df.join(copies).withColumn("doc_id", quality.F.expr(f"doc_id + copy * {far}")) for df in (
        small_docs, labels))
    assert quality.bucket_ratios(many, quality.trusted_ids(more)) == quality.bucket_ratios(
        small_docs, quality.trusted_ids(labels))


def test_quality_of_odd_rows(table, spark):
    rows = [(1, None), (2, ""), (None, "a b a b a b"), (3, "x y z " * 20_000), (4, " \n \n"), (4, " \n \n")]
    docs = table(rows)
    labels = spark.createDataFrame([(3, 1), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, quality.bucket_ratios(docs, quality.trusted_ids(labels))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and not any(r.kept for r in got)
    assert (by[None].n_words, by[None].n_repeat_words) == (6, 6) and by[3].n_repeat_words == 60_000
    assert (by[4].n_words, by[4].n_dup_lines, by[1].score) == (0, 0, 0.0)
    none = table([], name="none")
    assert quality.judge(none, quality.bucket_ratios(none, quality.trusted_ids(labels))).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got} == {True}
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_labels_of_long_or_few_documents_are_learned(table, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 1000)
    rows = [(1, "the cat and the dog " * 5000, "en")] + [(i, "der Hund und die Katze " * 5, "de") for i in range(3, 40)]
    rows += [(100 + i, f"wort{chr(97 + i // 26)}{chr(97 + i % 26)} sagt", f"x{i:03}") for i in range(210)]
    docs = table(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in docs.filter(~langid.held_out()).select("lang").distinct().collect()}
    model = langid.fit(docs, PIECES)
    assert set(model.languages) == learned and "en" in learned and len(learned) > 120
    asked = table([(1, "the dog and the cat"), (2, "die Katze und der Hund")], name="asked")
    got = {r.row.doc_id: r.lang_pred for r in langid.identify(asked, model, carry=["doc_id"]).collect()}
    assert got == {1: "en", 2: "de"}


def test_forward_sums_all_segmentations():
    import numpy as np
    import pyarrow as pa

    hashes, order = langid.pieces(PIECES)
    p = np.random.default_rng(1).random((1, len(hashes))) / 1000
    by_hash = dict(zip(hashes.tolist(), order.tolist()))

    def every(word):
        return 1.0 if not word else sum(
            every(word[k:]) * (p[0, by_hash[langid.piece_hash(word[:k])]] if langid.piece_hash(word[:k]) in by_hash
                               else langid.UNKNOWN if k == 1 else 0.0) for k in range(1, min(8, len(word)) + 1))

    words = ["the", "nation", "straße", "x", "日本", "retitioning"]
    got = langid.word_logs(langid.Model(PIECES, ("xx",), p), pa.array(words))[:, 0]
    assert np.allclose(got, np.log([every(w) for w in words]))


def test_language_of_odd_rows(table):
    rows = [(1, "the cat and the dog " * 5, "en"), (3, "der Hund und die Katze " * 5, "de"), (5, None, "en"),
            (6, "123 !?", None), (None, "the dog", "en"), (7, "und die Katze " * 3000, None), (7, "a" * 5000, None)]
    got = langid.predictions(table(rows, "doc_id long, text string, lang string"), PIECES).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 7 and by[5] == by[6] == "und" and by[None] in ("de", "en")
    none = table([], "doc_id long, text string, lang string", name="none")
    assert langid.predictions(none, PIECES).count() == 0
    unlabelled = table([(1, "some words", None)], "doc_id long, text string, lang string", name="u")
    assert [tuple(r)[2:] for r in langid.predictions(unlabelled, PIECES).collect()] == [("und", 0.0)]


def test_workers_give_back_what_a_task_took():
    pages = lambda: int(open("/proc/self/statm").read().split()[1]) // 256
    kept = []

    def rows(batches):
        taken = [bytearray(os.urandom(1)) * 60_000 for _ in range(5_000)]
        kept.append(bytearray(60_000))  # lies above the others, which therefore are not returned by themselves
        yield len(taken)

    before = pages()
    assert list(giving_back(rows)(iter([]))) == [5_000]
    assert pages() - before < 100
