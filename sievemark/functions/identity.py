"""Columns that bring unevenly written keys, labels and digests to one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of Unicode's White_Space property, and the byte-order mark.
WHITE_SPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends; null stays null."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def reference_key(image_id: Column) -> Column:
    """The value under which references to an image agree: no outer white space, one case."""
    return F.upper(stripped(image_id))


def label_key(label: Column) -> Column:
    """A group label without outer white space and case; blank is null."""
    return F.nullif(F.upper(stripped(label)), F.lit(""))


def level(category: Column, missing: str = "unknown") -> Column:
    """A category, trimmed and in lower case; null and blank read ``missing``."""
    return F.coalesce(F.nullif(F.lower(stripped(category)), F.lit("")), F.lit(missing))


def split_name(split: Column) -> Column:
    """train, val or test for every spelling of them; anything else, null included, is null."""
    short = F.lower(stripped(split))
    return (
        F.when(short.isin("train", "training"), "train")
        .when(short.isin("val", "valid", "validation"), "val")
        .when(short.isin("test", "testing"), "test")
    )


def _digits(text: Column) -> Column:
    """Hexadecimal digits without prefix, separators and case."""
    bare = F.translate(F.lower(text), WHITE_SPACE + ":-_", "")
    return F.when(F.startswith(bare, F.lit("0x")), F.substr(bare, F.lit(3))).otherwise(bare)


def hash64(text: Column) -> Column:
    """The bit pattern, as bigint, of a 64-bit number in hexadecimal; null if it is none.

    Prefix ``0x``, separators, case, outer white space and leading zeros do not matter.
    """
    digits = _digits(text)
    return F.when(digits.rlike("^[0-9a-f]{1,16}$"), F.conv(digits, 16, -10).cast("bigint"))


def digest128(text: Column) -> Column:
    """struct(hi, lo) of bigints with the bits of a 128-bit digest; null if the text is none."""
    bare = F.translate(F.lower(text), WHITE_SPACE + ":-_", "")
    digits = F.when(F.startswith(bare, F.lit("md5")), F.substr(bare, F.lit(4))).otherwise(_digits(text))
    return F.when(
        digits.rlike("^[0-9a-f]{32}$"),
        F.struct(
            F.conv(F.substring(digits, 1, 16), 16, -10).cast("bigint").alias("hi"),
            F.conv(F.substring(digits, 17, 16), 16, -10).cast("bigint").alias("lo"),
        ),
    )


def digest_text(text: Column) -> Column:
    """A 128-bit digest as 32 lower-case hexadecimal digits; null if the text is none."""
    bare = F.translate(F.lower(text), WHITE_SPACE + ":-_", "")
    digits = F.when(F.startswith(bare, F.lit("md5")), F.substr(bare, F.lit(4))).otherwise(_digits(text))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits)
