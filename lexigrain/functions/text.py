"""Text expressions: tokens, counts, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names the token rules below; an index opens only under the same name.
TOKENIZER = "letters-and-digits-lower-1"
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def split_whitespace(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def word_count(text: Column) -> Column:
    """Parts between single spaces; the empty text has one."""
    return F.size(F.split(text, " ")).cast("long")


def phone_number(number: Column) -> Column:
    """A country code and ten digits, zero-padded."""
    return F.concat(F.lit("+91-"), F.lpad(number.cast("string"), 10, "0"))


def phone_id(phone: Column) -> Column:
    """The number inside a phone_number(), else NULL."""
    return F.when(phone.startswith("+91-"), F.try_to_number(F.substring(phone, 5, 10), F.lit("9999999999")).cast("long"))


def short_count(n: Column) -> Column:
    """23000000 as 23M, 4096 as 4K, 12 as 12."""
    whole = lambda unit: F.floor(n / unit).cast("string")
    return F.when(n >= 1_000_000, F.concat(whole(1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(whole(1_000), F.lit("K"))).otherwise(F.floor(n).cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """A double with so many decimals as C's printf has it: its exact binary value is rounded, halves go to even.

    Java's formatter rounds a double's shortest text up instead, which makes 0.00375, in binary a bit less, 0.0038.
    Here the product with the power of ten is exact, as a double and its error (Dekker), and what is rounded by it has
    a text that needs no more rounding.  Values of 2^52 units or more are left to Java, as are NaN and infinities.
    """
    unit, split = 10.0**digits, 2.0**27 + 1
    product = x * unit
    high = x * split - (x * split - x)
    error = (high * unit - product) + (x - high) * unit
    whole = F.rint(product)
    over = product - whole
    whole = F.when((over == 0.5) & (error > 0), whole + 1).when((over == -0.5) & (error < 0), whole - 1).otherwise(whole)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.when(F.abs(product) < 2.0**52, whole / unit).otherwise(x)))


def signed_seconds(change: Column) -> Column:
    """Seconds saved as -1.50s, seconds lost as +1.50s; no change counts as lost."""
    return F.concat(F.when(change < 0, "-").otherwise("+"), fixed(F.round(F.abs(change), 2), 2), F.lit("s"))


def whole_batches(n: Column, size: int) -> Column:
    """How many batches of a size n rows make, the last one short."""
    return F.ceil(n / size).cast("long")


def name_of(code: Column, names: list[str]) -> Column:
    """The name of a code that counts from 0; NULL for any other."""
    return F.get(F.array(*map(F.lit, names)), code.cast("int"))
