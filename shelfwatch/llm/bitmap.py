"""A bounded filter that lets a scan drop rows before they are shuffled.

A bitmap of ``2**21`` bits (256 KiB, whatever the data) holds the low bits of 64-bit
keys. It is built by one aggregation of at most 32,768 words, which the driver reads
to put them into the plan as a constant. It has no false negatives. With many more
keys than bits it passes everything: results do not depend on it.
"""

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 1 << 15


def _word(key: str) -> str:
    return f"cast(shiftrightunsigned({key}, 6) & {WORDS - 1} as int)"


def bitmap_of(keys: DataFrame, column: str) -> Column:
    """The bitmap of a bigint column as a constant array; NULL keys are left out."""
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    words = keys.filter(F.col(column).isNotNull()).groupBy(F.expr(_word(column)).alias("word")).agg(F.bit_or(bit).alias("bits"))
    filled = [0] * WORDS
    for row in words.collect():  # at most WORDS rows
        filled[row["word"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")


def may_contain(bitmap: Column, key: Column) -> Column:
    """Whether the key may be in the bitmap; False is certain."""
    word = F.get(bitmap, (F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(WORDS - 1))).cast("int"))
    return F.getbit(word, key.bitwiseAND(F.lit(63)).cast("int")) == 1
