"""Sequence functions as column expressions: translation, distances, slices, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order TCAG at each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(seq: Column) -> Column:
    """Amino acids of the whole codons of a nucleotide sequence (upper case ACGT); an incomplete tail is dropped."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(seq) / 3).cast("int") - 1), lambda i: F.substr(F.lit(CODE), codon_of(seq, i), F.lit(1))), "")


def codon_of(seq: Column, i: Column) -> Column:
    return _letter(seq, i * 3 + 1) * 16 + _letter(seq, i * 3 + 2) * 4 + _letter(seq, i * 3 + 3) + 1


def _letter(seq: Column, at: Column) -> Column:
    return F.position(F.substr(seq, at, F.lit(1)), F.lit("TCAG")) - 1


def hamming(a: Column, b: Column) -> Column:
    """Number of places with different letters, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    one = lambda i: (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + one(i))).otherwise(0)


def once(f, *columns: Column) -> Column:
    """f of the columns, each worked out once a row: what a lambda over letters names is else worked out again for each letter."""
    row = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns)))
    return F.get(F.transform(F.array(row), lambda r: f(*(r[f"c{k}"] for k in range(len(columns))))), F.lit(0))


#: Letters of a packed number: two bits each, under the sign.
PACK = 24


def packed(seq: Column, length: int) -> list[Column]:
    """Numbers that hold a nucleotide sequence (ACGT) of at most `length` letters, two bits a letter, PACK letters a number."""
    digits = lambda k: F.conv(F.translate(F.substr(seq, F.lit(k + 1), F.lit(PACK)), "ACGT", "0123"), 4, 10).cast("long")
    return [F.coalesce(digits(k), F.lit(0).cast("long")) for k in range(0, length, PACK)]


def packed_hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing letters of two packed sequences of one length: a few machine instructions a pair, no letter by letter walk."""
    out = F.lit(0).cast("long")
    for x, y in zip(a, b):
        bits = x.bitwiseXOR(y)
        out = out + F.bit_count(bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(0x555555555555).cast("long")))
    return out


def packed_array(seq: Column) -> Column:
    """The same as packed() for sequences of any length, as an array."""
    digits = lambda k: F.coalesce(F.conv(F.translate(F.substr(seq, k * PACK + 1, F.lit(PACK)), "ACGT", "0123"), 4, 10).cast("long"), F.lit(0).cast("long"))
    return F.when(F.length(seq) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / PACK).cast("int")), digits))


def _marks(x: Column, y: Column) -> Column:
    """One bit at each place where packed numbers differ."""
    bits = x.bitwiseXOR(y)
    return bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(0x555555555555).cast("long"))


def array_differences(a: Column, b: Column) -> Column:
    """Differing letters of two packed arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(_marks(x, y))), F.lit(0), lambda s, n: s + n)


def array_shares(a: Column, b: Column, r: Column, q: Column) -> Column:
    """Places where a and b have the same letter and neither its own reference's, r for a and q for b."""
    own = F.zip_with(F.zip_with(a, r, _marks), F.zip_with(b, q, _marks), lambda x, y: x.bitwiseAND(y))
    apart = F.zip_with(a, b, _marks)
    return F.aggregate(F.zip_with(own, apart, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, n: s + n)


def weighted_hamming(a: Column, b: Column, penalty: Column) -> Column:
    """Sum of penalties over the places of equal-length sequences; penalty: map from two letters to a number, absent is 1."""
    cost = lambda i: F.coalesce(F.try_element_at(penalty, F.concat(F.substr(a, i, F.lit(1)), F.substr(b, i, F.lit(1)))), F.lit(1.0))
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0.0), lambda s, i: s + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), F.lit(0.0)).otherwise(cost(i)))


def identity_percent(a: Column, b: Column) -> Column:
    """Places alike, in hundredths of a percent of the longer sequence; '-' counts as a difference."""
    n = F.greatest(F.length(a), F.length(b))
    alike = F.least(F.length(a), F.length(b)) - hamming(a, b)
    return F.floor(alike.cast("double") * 10000 / n + 0.5) / 100


def barcode_number(barcode: Column) -> Column:
    """Letters ACGT as digits of base 4, in decimal, ten digits with leading zeros."""
    return F.lpad(F.conv(F.translate(barcode, "ACGT", "0123"), 4, 10), 10, "0")


def extend(seq: Column, start: Column, size: Column, left: int, right: int) -> Column:
    """The feature of `size` letters from 1-based start, longer by left and right letters (shorter if negative)."""
    return F.substr(seq, F.greatest(F.lit(1), start - left), size + left + right)


#: Fixed values: (left, right) extensions of the North definitions, in amino acids.
NORTH = {("heavy", 1): (3, 3), ("heavy", 2): (2, 3), ("light", 1): (0, 0), ("light", 2): (1, 0), ("heavy", 3): (-1, -1), ("light", 3): (-1, -1)}


def differences(seq: Column, ref: Column, most: int = 5) -> Column:
    """'12A,15C': places and letters where seq differs from ref, '...' after `most` of them, '+n' for n letters more than ref."""
    n = F.least(F.length(seq), F.length(ref))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(seq, i, F.lit(1)) != F.substr(ref, i, F.lit(1)))
    shown = F.transform(F.slice(at, 1, most), lambda i: F.concat((i - 1).cast("string"), F.substr(seq, i, F.lit(1))))
    more = F.when(F.size(at) > most, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    extra = F.when(F.length(seq) > F.length(ref), F.array(F.concat(F.lit("+"), (F.length(seq) - F.length(ref)).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(shown, more, extra), ",")
