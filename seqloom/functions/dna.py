"""Scalar functions on sequences, as column expressions.

Sequences are strings of A, C, G, T and N (masked).  A k-mer's code counts base j
as digit j of a number to base 4, lowest first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of the bases, their complements, IUPAC letters.
BASES, DIGITS, COMPLEMENTS = "ACGT", "0123", "TGCA"
IUPAC = "ACGTURYSWKMBDHVN"


def text_to_dna(text: Column) -> Column:
    """Text as a sequence: digits are masked, letters dealt over the bases."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "N"), "[^a-zN]", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", (BASES * 7)[:26])


def upper(seq: Column) -> Column:
    """Upper case of ASCII letters alone, so that no letter becomes two."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def recode_read(seq: Column) -> Column:
    """Every letter but a base is masked; positions stay."""
    return F.regexp_replace(upper(seq), "[^ACGT]", "N")


def recode_reference(seq: Column) -> Column:
    """What is no IUPAC letter is dropped, U is T, ambiguous letters are masked."""
    kept = F.regexp_replace(upper(seq), f"[^{IUPAC}]", "")
    return F.regexp_replace(F.translate(kept, "U", "T"), "[^ACGT]", "N")


def is_ambiguous(seq: Column) -> Column:
    return seq.rlike("[^ACGTacgt]")


def to_digits(seq: Column) -> Column:
    return F.translate(seq, BASES, DIGITS)


def from_digits(digits: Column) -> Column:
    return F.translate(digits, DIGITS, BASES)


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmer_code(kmer: Column) -> Column:
    """At most 31 bases without a mask."""
    return F.conv(F.reverse(to_digits(kmer)), 4, 10).cast("bigint")


def anchor_of(code: Column) -> Column:
    """The last nine bases of a 21-mer's code; the first twelve are the word."""
    return F.shiftrightunsigned(code, 24)


def word_of(code: Column) -> Column:
    return code.bitwiseAND(F.lit(0xFFFFFF))


def letter_at(seq: Column, position: Column) -> Column:
    return F.substring(seq, position + 1, F.lit(1))


def with_letter(seq: Column, position: Column, letter: Column) -> Column:
    return F.overlay(seq, letter, position + 1, F.lit(1))


def exact_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix without masked letters."""
    least = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))) | (F.substring(a, i, F.lit(1)) == "N"))
    return F.when(least == 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, least))


def exact_prefix_reverse(a: Column, b: Column) -> Column:
    """The same of ``a`` and the reverse complement of ``b``."""
    return exact_prefix(a, reverse_complement(b))


def trailing_zeros(x: Column) -> Column:
    """Low clear bits of a long; 64 for 0."""
    return F.when(x == 0, 64).otherwise(F.instr(F.reverse(F.bin(x)), "1") - 1)


def trailing_ones(x: Column) -> Column:
    """Low set bits of a long."""
    return trailing_zeros(F.bitwise_not(x))


def bit_field(x: Column, start: int, stop: int) -> Column:
    """Bits start to before stop, fewer than 63 of them."""
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << (stop - start)) - 1))


def code_of(index: Column) -> Column:
    """Strands and mates have the codes 1 and 2 for the indices 0 and 1."""
    return index + 1


def index_of(code: Column) -> Column:
    return code - 1


def strand_of(text: Column, forward: str = "+", reverse: str = "-") -> Column:
    """The strand's code from its letter; anything else is an error."""
    return F.when(text == forward, 1).when(text == reverse, 2).otherwise(F.raise_error(F.concat(F.lit("not a strand: "), F.coalesce(text, F.lit("null")))))


def poly_a_tail(seq: Column, least: int, ratio: float) -> Column:
    """Length of the tail of a sequence that is rich in A: at least the share ``ratio``.

    If the last ``least`` bases are, the tail grows from there as long as it is;
    otherwise it is the longest shorter one that is.  Masked bases are no A.
    """
    share = F.lit(ratio).cast("float")

    def step(a: Column, letter: Column) -> Column:
        n, many = a["n"] + 1, a["many"] + F.when(letter == "A", 1).otherwise(0)
        rich = many.cast("float") >= n.cast("float") * share
        growing = F.when(n <= least, rich).otherwise(a["growing"] & rich)
        best = F.when(rich & ((n <= least) | a["growing"]), n).otherwise(a["best"])
        return F.struct(n.alias("n"), many.alias("many"), best.alias("best"), growing.alias("growing"))

    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("many"), F.lit(0).alias("best"), F.lit(False).alias("growing"))
    letters = F.filter(F.split(F.reverse(seq), ""), lambda x: x != "")
    return F.aggregate(letters, begin, step, lambda a: a["best"])


def intron_penalty(scale: float, growth: float, intron: Column, read: Column) -> Column:
    return read * scale * (F.exp(intron * growth) - 1)


def defline_id(line: Column) -> Column:
    """The id of a header line: up to the first blank."""
    return F.regexp_extract(line, r"^[>@]([^ \t]*)", 1)


def combine_ids(first: Column, second: Column) -> Column:
    """The id of a pair; null where the two do not belong together.

    Equal ids, or ids that differ in a last 1 and 2 after one of ``. _ /``.
    """
    stem = F.length(first) - 2
    mates = (F.length(first) == F.length(second)) & (F.length(first) > 2) & first.rlike("[._/]1$") & second.rlike("[._/]2$") & (F.substring(first, F.lit(1), stem + 1) == F.substring(second, F.lit(1), stem + 1))
    return F.when(first == second, first).when(mates, F.substring(first, F.lit(1), stem))


def require(value: Column, message: str) -> Column:
    """``value``, or an error where it is null."""
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def log2_bin(count: Column) -> Column:
    """The least i with count <= 2**i, in integers."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(0)


def general_format(x: Column) -> Column:
    """A ratio as C's %g prints it: six significant digits, no trailing zeros."""
    digits = F.when(x >= 1, 5).when(x >= 0.1, 6).when(x >= 0.01, 7).when(x >= 0.001, 8).otherwise(9)
    text = F.lit(None).cast("string")
    for k in range(5, 10):
        text = F.when(digits == k, F.format_string(f"%.{k}f", x.cast("double"))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def is_gzip(name: Column) -> Column:
    return name.endswith(".gz") & (F.length(name) > 3)
