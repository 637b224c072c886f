"""Keyed pseudonyms for customer references that leave the CN region."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pseudonym format.
MASK_PREFIX = "msk-"
MASK_HEX_CHARS = 12
MASKED_REGION = "CN"

_BLOCK = 64


def hmac_pads(secret: bytes) -> tuple[bytes, bytes]:
    """Inner and outer HMAC-SHA256 pads; a key above one block is hashed first."""
    key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 from the built-in `sha2`, so it runs inside generated code.

    Both pads are literals of the plan and lead back to the secret, so plans and event logs of such a job are as
    secret as it is; `spark.sql.redaction.string.regex` can hide them in plan texts.
    """
    inner_pad, outer_pad = hmac_pads(secret)
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def needs_mask(customer_ref: Column, region: Column) -> Column:
    """True when this reference has to be masked on egress from this region."""
    blank = F.trim(customer_ref) == ""
    return F.coalesce((region == MASKED_REGION) & customer_ref.isNotNull() & ~blank, F.lit(False))


def mask_customer_ref(customer_ref: Column, region: Column, secret: str) -> Column:
    """`msk-` plus 12 hex digits for a CN reference; anything else, null and blank pass unchanged."""
    digest = F.substring(hmac_sha256_hex(customer_ref, secret.encode()), 1, MASK_HEX_CHARS)
    return F.when(needs_mask(customer_ref, region), F.concat(F.lit(MASK_PREFIX), digest)).otherwise(customer_ref)
