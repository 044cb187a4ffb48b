"""Base-36 text keys and the row hash used for reproducible sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the texts that are an integer in base 36. Either letter case, a sign,
# single underscores between digits and blanks around are allowed; thirteen digits
# after leading zeros are the most that can fit 64 bits. Plain keys come first.
LEGAL_BASE36 = (
    r"^(?:[0-9A-Za-z]{1,12}"
    r"|\s*[+-]?(?:0_?)*[0-9A-Za-z](?:_?[0-9A-Za-z]){0,12}\s*)$"
)
# Fixed value: the largest 64-bit integer in base 36. Its negative counterpart is the lowest one read.
LARGEST_BASE36 = "1Y2P0IJ32E8E7"

HASH_BITS = 60


def decode_base36(col: Column, strict: bool = False) -> Column:
    """Base-36 text to bigint, as one native expression.

    Text that is not a base-36 integer, or is too long for 64 bits, gives NULL, or
    stops the job when ``strict``. A missing key stays NULL in both modes.
    """
    text = col.cast("string")
    # conv() reads a bad text up to its first bad letter, so bad texts are masked first.
    digits = F.when(text.rlike(LEGAL_BASE36), F.translate(text, "+_ \t\n\r\x0b\x0c", ""))
    long = F.upper(F.ltrim(F.translate(digits, "-", ""), F.lit("0")))
    fits = (F.length(digits) <= 12) | (F.length(long) <= 12) | (long <= LARGEST_BASE36)
    # A negative base reads the sign.
    value = F.when(fits, F.conv(digits, 36, -10)).cast("bigint")
    if not strict:
        return value
    message = F.concat(F.lit("not a base-36 key: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)


def encode_base36(col: Column) -> Column:
    """Non-negative bigint to upper-case base-36 text."""
    return F.conv(col.cast("string"), 10, 36)


def row_hash(seed: int, *key: str) -> Column:
    """A 60-bit hash of the seed and the key columns, the same on any engine with md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")
