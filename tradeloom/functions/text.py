"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

#: White space of any script, and the control characters that come with it (the plain trim() knows only the blank).
SPACES = "".join(map(chr, [*range(0x00, 0x21), 0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """c without white space at its ends; null stays null."""
    return F.btrim(c, F.lit(SPACES))


def canonical_symbol(c: Column) -> Column:
    """Symbol without surrounding white space, in upper case."""
    return F.upper(strip(c))


def eight_decimals(df: DataFrame, name: str) -> Column:
    """Number column as text with eight decimals: doubles by format, decimals exactly; null stays null."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, DecimalType):
        d = c.cast("decimal(38,8)")
        cents = F.abs(d * F.lit(100_000_000).cast("decimal(10,0)")).cast("decimal(38,0)").cast("string")
        digits = F.when(F.length(cents) < 9, F.lpad(cents, 9, "0")).otherwise(cents)
        return F.concat(F.when(d < 0, "-").otherwise(""), F.substring(digits, F.lit(1), F.length(digits) - 8), F.lit("."), F.right(digits, F.lit(8)))
    return F.when(c.isNotNull(), F.format_string("%.8f", c.cast("double")))


def bytes_text(c: Column) -> Column:
    """A size as text in the largest of B, KB, MB, GB, TB that leaves at least 1."""
    out = F.concat(c.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(c >= 1024**i, F.concat(F.format_string("%.2f", c / 1024**i), F.lit(f" {unit}"))).otherwise(out)
    return F.when(c.isNotNull(), out)


def money_text(c: Column, digits: int = 2) -> Column:
    """An amount with thousands separated, half up."""
    return F.format_number(c.cast("double"), digits)


def hex_text(c: Column) -> Column:
    """Bytes as small hexadecimal digits."""
    return F.lower(F.hex(c))


def clock_text(c: Column) -> Column:
    """The clock of a moment with milliseconds, in the session's zone."""
    return F.date_format(c, "HH:mm:ss.SSS")
