"""Nucleotide expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dna(text: Column, length: int | None = None) -> Column:
    """The letters A, C, G and T of a text, in upper case."""
    letters = F.regexp_replace(F.upper(text), "[^ACGT]", "")
    return letters if length is None else F.substring(letters, 1, length)


def encode(seq: Column) -> Column:
    """A, C, G, T of either case as 0 to 3, everything else as 4; one digit a base."""
    return F.translate(F.regexp_replace(seq, "(?s)[^ACGTacgt]", "N"), "ACGTacgtN", "012301234")


def reverse_complement(seq: Column) -> Column:
    """Of upper-case bases; others stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reverse_complement_codes(codes: Column) -> Column:
    """Of encoded bases; 4 stays 4."""
    return F.reverse(F.translate(codes, "0123", "3210"))


def reverse_prefix(seq: Column, length: int | Column) -> Column:
    """The first `length` characters in reverse, the rest as it is."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.reverse(F.substring(seq, F.lit(1), n)), F.substring(seq, n + 1, F.length(seq)))


def match_score(a: Column, b: Column, match: int = 1, mismatch: int = 3) -> Column:
    """Byte by byte: case matters, and any letter matches itself."""
    return F.when(a == b, F.lit(match)).otherwise(F.lit(-mismatch))


def score_matrix(match: int = 1, mismatch: int = 3) -> list[list[int]]:
    """5 x 5 scores of encoded bases; the fifth, ambiguous, scores 0 against all."""
    return [[0 if 4 in (i, j) else match if i == j else -mismatch for j in range(5)] for i in range(5)]
