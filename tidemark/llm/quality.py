"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Tokens are runs of letters, digits and underscores, or runs of other characters that are no white space. Each token and
each pair of neighbouring tokens is hashed to one of `BUCKETS` buckets. Two multinomials over the buckets are counted:
the raw one over every document, the target one over the trusted documents. A document's score is the mean of
log(target / raw) over its n-grams; it is kept if it passes the base rules and its score reaches `THRESHOLD`. The target
is smoothed by the raw distribution with `PRIOR` times the weight of its own counts, a share, so that a bucket the target
has hardly seen says little and scores mean the same in small and large tables. Ratios are rounded to
thousandths and summed as integers, so the verdict is the same in every run.

The trusted documents are fitted on at most `TRUSTED_ROWS` labelled ids, those with the smallest hash; this is the only
sample. All counts, scores and verdicts cover every whole document.

Base rules: fewer than 50 words fail, and so does a text of which more than half of the words lie in three-word windows
found twice or more. Windows of one text are compared by a 64-bit hash; repeats are found by sorting (hash, place), so
the work per text is n log n.

Cases: a null or empty text has no words, all counts 0 and score 0, and fails; a null id is carried; repeated rows give
repeated rows; with no trusted document every ratio is 0; an empty table gives an empty result. Only id and text are
read, so extra columns cannot clash; whole texts count, whatever their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import once, whole_text

BUCKETS, PRIOR, TRUSTED_ROWS = 1 << 14, 0.3, 20_000

#: Mean log ratio below which a document fails.
THRESHOLD = -0.25

MIN_WORDS, REPEAT_PERCENT = 50, 50
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SPACE = r"[\x20\x09-\x0D]"


def ngram_buckets(text: Column) -> Column:
    """Buckets of all tokens and all neighbouring pairs; the last token pairs with the end."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    both = lambda t: F.concat(
        F.transform(t, lambda w: bucket(F.xxhash64(w))),
        F.transform(t, lambda w, i: bucket(F.xxhash64(w, F.get(t, i + 1)))))
    # the tokens are bound by a lambda, so that they are extracted once
    return F.aggregate(F.array(tokens), F.array().cast("array<int>"), lambda _, t: both(t))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """At most `most` distinct ids of documents labelled good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """log(target / raw) of every bucket in thousandths. Only one row per bucket reaches the driver."""
    ids = trusted.select(F.col("doc_id").alias("id"), F.lit(1).alias("good"))
    grams = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(
        F.broadcast(ids), "id", "left").select("good", F.explode(ngram_buckets(F.col("text"))).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()
    raw, target = sum(r.raw for r in counted), sum(r.target for r in counted)
    ratios, prior = [0] * BUCKETS, PRIOR * target
    for r in counted if target else ():
        p = r.raw / raw
        ratios[r.bucket] = round(1000 * math.log((r.target + prior * p) / ((target + prior) * p)))
    return ratios


def _repeat_words() -> Column:
    """Words in repeated windows, from `places`: the sorted starts of the windows found twice or more."""
    step = lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), j + 1) - p, F.lit(3)))
    return F.aggregate(F.transform("places", step), F.lit(0), lambda a, x: a + x)


def judge(docs: DataFrame, ratios: list[int], id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    # folded to one array literal by the optimizer
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    text, words, windows, ordered = F.col("text"), F.col("words"), F.col("windows"), F.col("ordered")
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = ngram_buckets(text)
    total = lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))
    score = F.aggregate(F.array(grams), F.lit(0.0), lambda _, g: F.when(F.size(g) == 0, 0.0).otherwise(
        total(g) / (F.size(g) * 1000.0)))
    step = once(
        docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")),
        words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")),
        word_chars=(F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint"),
        n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        n_dup_lines=F.when(F.contains(text, F.lit("\n")), F.aggregate(
            F.array(lines), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
        .cast("bigint"),
        score=score).drop("text")
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    step = once(step, n_words=F.size(words).cast("bigint"), windows=F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), window)).drop("words")
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    step = once(step, ordered=F.when(repeats, F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
    place = lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])
    step = once(step, places=F.sort_array(F.array_compact(F.transform(ordered, place)))).drop("ordered")
    step = once(step, n_repeat_words=F.coalesce(_repeat_words(), F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return step.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
