"""Sequence functions as column expressions, and Arrow functions where none exists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes, their complements and the bases that each stands for.
CODES = "ACGTUMRWSYKVHDBN"
COMPLEMENTS = "TGCAAKYWSRMBDHVN"
BASES_OF = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}


def split_nonempty(text: Column, delimiter: str) -> Column:
    """Parts of a text between delimiters, empty ones left out."""
    return F.filter(F.split(text, f"[{delimiter}]" if len(delimiter) == 1 and delimiter not in "\\^]" else delimiter), lambda x: x != "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def is_valid_sequence(seq: Column) -> Column:
    return seq.rlike(f"\\A[{CODES}{CODES.lower()}]+\\z")


def base_at(seq: Column, pos: Column, minus: Column) -> Column:
    """Base at a 1-based position of the strand; the minus strand counts from the other end."""
    there = F.when(minus, F.length(seq) - pos + 1).otherwise(pos)
    base = F.substring(seq, there.cast("int"), F.lit(1))
    return F.when(minus, reverse_complement(base)).otherwise(base)


def subsequence(seq: Column, start: Column, end: Column, minus: Column) -> Column:
    part = F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(minus, reverse_complement(part)).otherwise(part)


def matches_base(read: Column, reference: Column) -> Column:
    """Whether a read base is one of those that a reference code stands for."""
    table = F.create_map(*[F.lit(x) for code in CODES for x in (code, BASES_OF[code])])
    allowed = F.coalesce(F.try_element_at(table, F.upper(reference)), F.lit(""))
    return (F.length(read) == 1) & (F.instr(allowed, F.upper(read)) > 0)


def is_homopolymer(seq: Column) -> Column:
    """All characters equal; sequences of up to one character are."""
    return F.length(F.replace(seq, F.substring(seq, 1, 1), F.lit(""))) == 0


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, case-insensitive; 0 if either is empty."""
    a, b = F.upper(a), F.upper(b)
    longer = F.greatest(F.length(a), F.length(b))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def is_similar(a: Column, b: Column, threshold: float) -> Column:
    """similarity >= threshold, with the edit distance cut off where it no longer matters.

    Lengths alone rule most unlike pairs out before any distance is computed.
    """
    a, b = F.upper(a), F.upper(b)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    within = 1 - F.levenshtein(a, b) / longer >= threshold
    return F.when(shorter == 0, F.lit(threshold <= 0)).when(shorter < longer * threshold, False).otherwise(within)


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k, in order; none for shorter sequences."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_hashes(seq: Column, k: int) -> Column:
    """64-bit hashes of all k-mers, in order.

    Cut from a fixed-width encoding, where finding a character takes no scan.
    """
    wide = F.encode(seq, "UTF-32")
    cut = F.transform(F.array(wide), lambda w: F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.xxhash64(F.substring(w, i * 4 + 1, F.lit(4 * k)))))[0]
    return F.when(F.length(seq) >= k, cut).otherwise(F.array().cast("array<bigint>"))


def minimizers(seq: Column, window: int = 10, k: int = 15) -> Column:
    """Distinct (hash, position) minima over windows of consecutive k-mers, by position.

    The hash is the k-mer read as a number in base 4; of equal ones the first position counts.
    """
    digits = F.translate(F.upper(seq), "ACGT", "0123")
    numbers = F.transform(kmers(digits, k), lambda x, i: F.struct(F.conv(x, 4, 10).cast("decimal(20,0)").alias("hash"), i.alias("pos")))
    several = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers) - window + 1, F.lit(1))), lambda i: F.array_min(F.slice(numbers, i, F.lit(window))))
    return F.when(F.size(numbers) > 0, F.array_distinct(several)).otherwise(F.array().cast("array<struct<hash:decimal(20,0),pos:int>>"))


def common_minimizers(a: Column, b: Column) -> Column:
    """Hashes that two minimizer arrays share."""
    return F.array_intersect(F.transform(a, lambda x: x["hash"]), F.transform(b, lambda x: x["hash"]))
