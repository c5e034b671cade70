"""Nucleotide and protein sequence functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard code in the order TCAG for each of the three bases.
BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Codons of each amino acid. The order matters: the first one stands for the
#: amino acid where one is wanted, and ties between candidates go by it. Z is Q or E, B is N or D.
CODONS_OF = {
    "A": ["GCA", "GCC", "GCG", "GCT"],
    "C": ["TGT", "TGC"],
    "E": ["GAG", "GAA"],
    "D": ["GAC", "GAT"],
    "G": ["GGT", "GGG", "GGA", "GGC"],
    "F": ["TTT", "TTC"],
    "I": ["ATC", "ATA", "ATT"],
    "H": ["CAT", "CAC"],
    "K": ["AAG", "AAA"],
    "M": ["ATG"],
    "L": ["CTT", "CTG", "CTA", "CTC", "TTA", "TTG"],
    "N": ["AAC", "AAT"],
    "Q": ["CAA", "CAG"],
    "P": ["CCT", "CCG", "CCA", "CCC"],
    "S": ["AGC", "AGT", "TCT", "TCG", "TCC", "TCA"],
    "R": ["AGG", "AGA", "CGA", "CGC", "CGG", "CGT"],
    "T": ["ACA", "ACG", "ACT", "ACC"],
    "W": ["TGG"],
    "V": ["GTA", "GTC", "GTG", "GTT"],
    "Y": ["TAT", "TAC"],
    "*": ["TAA", "TAG", "TGA"],
    "Z": ["CAA", "CAG", "GAG", "GAA"],
    "B": ["AAC", "AAT", "GAC", "GAT"],
}
#: Three-letter names of amino acids.
THREE_LETTERS = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "E": "Glu", "Q": "Gln", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys",
    "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "U": "Sec", "O": "Pyl", "*": "X",
}


def bind(columns: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """then(struct of columns), each of which is evaluated once however often `then` mentions it."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))), then), F.lit(0))


def literal_map(values: dict[str, str | list[str]]) -> Column:
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), lit(v))))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


#: All codons in the order of the code, each after a blank.
_CODONS = "".join(f" {a}{b}{c}" for a in BASES for b in BASES for c in BASES)


def codon_aa(codon: Column) -> Column:
    """One-letter amino acid; null unless the codon is three of ACGT."""
    at = F.instr(F.lit(_CODONS), F.concat(F.lit(" "), codon))
    return F.nullif(F.substr(F.lit(STANDARD_CODE), F.shiftright(at + 3, 2), F.when((at > 0) & (F.length(codon) == 3), 1).otherwise(0)), F.lit(""))


def translate_all(cds: Column) -> Column:
    """Amino acids of all whole codons, stops included; X for a codon that has none.

    The codons are cut in one pass: a substr for each would walk from the
    beginning every time, which costs the square of the length.
    """
    table = literal_map({a + b + c: STANDARD_CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)})
    codons = F.transform(F.regexp_extract_all(cds, F.lit("(?s)..."), F.lit(0)), lambda c: F.coalesce(table[c], F.lit("X")))
    return F.array_join(codons, "")


def first_stop(s: Column) -> Column:
    """Which codon of s is its first stop, from 1; 0 if none is."""
    return (F.length(F.regexp_extract(s, "^(?s:...)*?(?:TAA|TAG|TGA)", 0)) / 3).cast("int")


def translate(cds: Column) -> Column:
    """Protein of whole codons, up to and with the first stop; nothing behind that is translated."""
    return bind({"s": cds, "n": first_stop(cds)}, lambda x: translate_all(F.when(x["n"] > 0, F.left(x["s"], 3 * x["n"])).otherwise(x["s"])))


def first_change(a: Column, b: Column, near: int = 8) -> Column:
    """Which codon of two sequences is the first with another amino acid, from 1; null if one protein begins with the other.

    The first few codons are translated; where these are equal, what lies before
    the next base that differs is passed over, then more, and all, are.
    """

    def part(x: Column, s: str, skip: Column, n: int) -> Column:
        return translate_all(F.substr(x[s], 3 * skip + 1, F.lit(n)))

    def beyond(x: Column) -> Column:
        skip = F.floor((x["d"] - 1) / 3).cast("int")
        return F.coalesce(*(skip + first_difference(part(x, "a", skip, n), part(x, "b", skip, n)) for n in (24 * near, 2**31 - 1)))

    far = bind({"a": a, "b": b, "d": first_difference(a, b)}, lambda x: F.when(x["d"].isNotNull(), beyond(x)))
    first = first_difference(translate_all(F.left(a, F.lit(3 * near))), translate_all(F.left(b, F.lit(3 * near))))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(first, far))


def until_stops(s: Column) -> Column:
    """s up to where each of its three frames has had a stop codon, so that reading on into it misses none; all of s if a frame has none."""
    ends = [F.length(F.regexp_extract(F.substr(s, F.lit(k + 1), F.length(s)), "^(?s:...)*?(?:TAA|TAG|TGA)", 0)) for k in range(3)]
    return F.substr(s, F.lit(1), F.greatest(*(F.when(n > 0, n + k).otherwise(F.length(s)) for k, n in enumerate(ends))))


def codons_of(aa: Column) -> Column:
    return F.element_at(literal_map(CODONS_OF), aa)


def alternatives(codon: str, aa: str) -> list[tuple[int, str]]:
    """Other codons of an amino acid with the number of bases that differ, the fewest first, then in table order."""
    others = [(sum(x != y for x, y in zip(c, codon, strict=True)), c) for c in CODONS_OF[aa] if c != codon]
    return sorted(others, key=lambda x: x[0])


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two short strings of bases: the first place after which they go on differently, or one ends."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("|"), b), r"^([^|]*?)(?:([^|])[^|]*+)?\|\1(?!\2)", 1))


def first_difference(a: Column, b: Column) -> Column:
    """Where two strings first differ, from 1; null if one begins with the other.

    The place is halved down to: of the part of 2**k characters at hand, either
    the first half differs, or the second is looked at.  So a pass costs as much as
    comparing the strings twice, and no arrays of letters are made.
    """
    n = F.least(F.length(a), F.length(b))

    def halved(x: Column) -> Column:
        part = lambda s, at, size: F.substr(x[s], at, size)
        bits = F.transform(F.sequence(F.lit(0), F.greatest(F.length(F.bin(x["n"])) - 1, F.lit(0))), lambda k: F.call_function("shiftleft", F.lit(1), (F.length(F.bin(x["n"])) - 1 - k).cast("int")))
        same = F.aggregate(bits, F.lit(0), lambda at, size: F.when((at + size <= x["n"]) & (part("a", at + 1, size) == part("b", at + 1, size)), at + size).otherwise(at))
        return F.when(same < x["n"], same + 1)

    return bind({"a": a, "b": b, "n": n}, halved)


def trim(ref: Column, alt: Column) -> Column:
    """struct(ref, alt, head): the common prefix cut off first, then the common suffix."""
    def shared(a: Column, b: Column) -> Column:
        return F.coalesce(first_difference(a, b) - 1, F.least(F.length(a), F.length(b)))

    def cut(x: Column) -> Column:
        return bind({"r": F.substr(x["r"], x["head"] + 1, F.length(x["r"])), "a": F.substr(x["a"], x["head"] + 1, F.length(x["a"])), "head": x["head"]}, back)

    def back(x: Column) -> Column:
        tail = {"r": x["r"], "a": x["a"], "head": x["head"], "tail": shared(F.reverse(x["r"]), F.reverse(x["a"]))}
        return bind(tail, lambda y: F.struct(F.substr(y["r"], F.lit(1), F.length(y["r"]) - y["tail"]).alias("ref"), F.substr(y["a"], F.lit(1), F.length(y["a"]) - y["tail"]).alias("alt"), y["head"].alias("head")))

    return bind({"r": ref, "a": alt, "head": shared(ref, alt)}, cut)


def shortened(s: Column, ends: int = 3) -> Column:
    """ABC..XYZ: a long text by its ends."""
    return F.when(F.length(s) > 2 * ends + 2, F.concat(F.left(s, F.lit(ends)), F.lit(".."), F.right(s, F.lit(ends)))).otherwise(s)


def context(protein: Column, pos: Column, around: int = 5) -> Column:
    """xx[R]yy: the amino acid at pos between those around it."""
    low = F.greatest(pos - around, F.lit(1))
    return F.concat(F.substr(protein, low, pos - low), F.lit("["), F.substr(protein, pos, F.lit(1)), F.lit("]"), F.substr(protein, pos + 1, F.lit(around)))


def clamped(beg: Column, end: Column, size: Column) -> Column:
    """struct(beg, end) of a region cut to its contig."""
    return F.struct(F.least(F.greatest(beg, F.lit(1)), size).alias("beg"), F.greatest(F.least(end, size), F.lit(1)).alias("end"))
