"""Column expressions shared by the operators.

Missing is NULL everywhere: NaN and infinities become NULL where data enter, so
that comparisons and aggregates agree with the usual meaning of a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: contigs that are not autosomes, and texts that mean a missing number
NON_AUTOSOMES = ("chrX", "chrY", "chrM", "chrMT", "X", "Y", "M", "MT")
MISSING_TEXT = ("", "na", "nan", "null", "none", "missing", ".")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(x: Column) -> Column:
    """x, or NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number(text: Column) -> Column:
    """A text as a double; NULL for missing-value texts and for anything that is not a plain number."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*MISSING_TEXT) & t.rlike(_NUMBER), t.try_cast("double"))


def truth(text: Column) -> Column:
    """true, 1, yes; false, 0, no; anything else NULL."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def autosomal(chrom: Column) -> Column:
    return ~chrom.isin(*NON_AUTOSOMES)


def variant_id(chrom: Column, pos: Column, vid: Column, ref: Column, alts: Column) -> Column:
    """The record's id, or chrom:pos:ref:alts."""
    return F.coalesce(F.nullif(vid, F.lit(".")), F.concat_ws(":", chrom, pos.cast("string"), ref, F.array_join(alts, ":")))


def chrom_order(chrom: Column) -> Column:
    """Autosome number, X 23, Y 24, M 25, any other contig 99."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return F.when(bare.rlike(r"^\d+$"), bare.try_cast("int")).when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(99)


def sex_code(text: Column) -> Column:
    """1 male, 2 female, NULL unknown."""
    t = F.upper(F.trim(text))
    return F.when(t.isin("M", "MALE", "1"), 1).when(t.isin("F", "FEMALE", "2", "0"), 2)


def minus_log10(p: Column) -> Column:
    return -F.log10(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)))


def tested(p: Column) -> Column:
    """A p-value that can be used: finite, above 0, at most 1."""
    return p.isNotNull() & ~F.isnan(p) & (p > 0) & (p <= 1)
