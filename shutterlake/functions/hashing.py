"""64-bit perceptual hashes kept as '0'/'1' text at the boundary and BIGINT inside joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64


def hash_bits(block: Column) -> Column:
    """64 coefficients -> 64 characters: above the median of the last 63, or not."""
    ac_sorted = F.array_sort(F.slice(block, 2, HASH_BITS - 1))
    median = F.element_at(ac_sorted, HASH_BITS // 2)
    # One-element array as a binding, so that the median is sorted out once and not per coefficient.
    bound = F.array(F.struct(block.alias("values"), median.alias("median")))
    bits = F.transform(
        bound,
        lambda b: F.array_join(
            F.transform(b["values"], lambda x: F.when(x > b["median"], "1").otherwise("0")), ""
        ),
    )
    return F.element_at(bits, 1)


def bits_to_long(bits: Column) -> Column:
    """Signed 64-bit value of a bit string."""
    return F.conv(bits, 2, -10).cast("bigint")


def hamming_long(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def hamming(left: Column, right: Column) -> Column:
    """Differing positions of two bit strings; unequal lengths are an error."""
    distance = hamming_long(bits_to_long(left), bits_to_long(right))
    return F.when(F.length(left) == F.length(right), distance).otherwise(
        F.raise_error(F.lit("hashes differ in length")).cast("int")
    )
