"""The registered queries of this subpackage, one per operator, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment,
    bpe,
    exact_dedup,
    jaccard,
    langid,
    mixing,
    packing,
    periodic,
    quality,
    secrets,
    substring,
    token_counts,
    warc,
)
from tidemark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, table: str = "documents", *more: str, sql: str | None = None):
    """Register `build(frame, ...)` over whole tables."""

    def add(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda name: configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
            return build(*map(read, (table, *more)))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@register("op1_jaccard_join")
def op1(docs: DataFrame) -> DataFrame:
    """Class and links of every document by the similarity of its five-word shingles."""
    return jaccard.join_report(docs)


@register("op2_mixing", sql=r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
r AS (SELECT *, (SELECT sum(source_size) FROM w) AS total,
             coalesce(sum(most) OVER lower_ones, 0) AS used,
             (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER lower_ones, 0) AS rest
      FROM w WINDOW lower_ones AS (ORDER BY most / CAST(weight AS DOUBLE), place
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(total - used AS DOUBLE) / CAST(rest AS DOUBLE) AS share,
             row_number() OVER (ORDER BY most / CAST(weight AS DOUBLE), place) AS pos FROM r),
v AS (SELECT min(pos) AS pos FROM f WHERE share * weight < most),
t AS (SELECT source, source_size, CASE WHEN f.pos >= v.pos THEN (SELECT share FROM f, v WHERE f.pos = v.pos) * weight
             ELSE CAST(most AS DOUBLE) END AS target FROM f, v),
q AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS quota,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(size * (quota // source_size)
       + greatest(least(start + size, quota % source_size) - start, 0) AS BIGINT) END AS taken, source
FROM q
""")
def op2(docs: DataFrame) -> DataFrame:
    """The share of every document in the mix."""
    return mixing.mix(docs)


@register("op3_substring_dedup")
def op3(docs: DataFrame) -> DataFrame:
    """Words of every document that repeat a passage of 20 words, removed."""
    return substring.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_bpe")
def op4(docs: DataFrame) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@register("op5_warc", "pages", sql="""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
""")
def op5(pages: DataFrame) -> DataFrame:
    """Pages through WARC records in ZIP packages."""
    return warc.round_trip(pages)


@register("op6_secret_scan")
def op6(docs: DataFrame) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan(docs)


@register("op7_exact_dedup", sql="""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op7(docs: DataFrame) -> DataFrame:
    """Exact duplicates of every document."""
    return exact_dedup.duplicate_report(docs)


@register("op8_token_counts")
def op8(docs: DataFrame) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op9_language_id")
def op9(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return langid.predictions(docs, public_tokenizers.path("piece_bpe_32k.model"))


@register("op10_quality_rules", "documents", "labels")
def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality rules and the log-likelihood verdict for every document."""
    return quality.judge(docs, quality.bucket_ratios(docs, quality.trusted_ids(labels)))


@register("op11_periodic_runs")
def op11(docs: DataFrame) -> DataFrame:
    """Periodic runs of every document and its words without their repetitions, as digests."""
    return periodic.run_report(docs)


@register("op12_bin_packing")
def op12(docs: DataFrame) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op13_token_alignment")
def op13(docs: DataFrame) -> DataFrame:
    """How the tokens of the byte-level and the piece vocabulary cover each other in every document."""
    return alignment.alignment_report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                      public_tokenizers.path("piece_bpe_32k.model"))
