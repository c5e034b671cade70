"""HGVS-like identifiers by column expressions: first the place, then what is done there.

A text is a place (n or n_m) and a change.  Each change has a form of its own,
and the first form that fits says what kind of variant it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import THREE_LETTERS, bind, literal_map

_BASES, _AMINO = "[ACGTNacgtn]", "[A-Za-z*]"


def _groups(text: Column, form: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, form, i) for i in range(1, n + 1)]


def _or_nulls(got: Column, fields: dict[str, str]) -> Column:
    """A null struct as one of nulls.  It is mentioned once: generators and lambdas would read the text anew for each of its fields."""
    return F.coalesce(got, F.struct(*(F.lit(None).cast(t).alias(f) for f, t in fields.items())))


def _nucleotides(text: Column, level: str, place: str) -> Column:
    start = rf"^(?:{level}\.)?({place})(?:_({place}))?\.?"
    forms = {
        "sub": rf"^({_BASES}*|\?)>({_BASES}*|\?)$", "del": rf"^del({_BASES}*|\d+)$", "delins": rf"^del({_BASES}*|\d+)ins({_BASES}+)$",
        "ins": rf"^ins({_BASES}+)$", "dup": rf"^dup({_BASES}*|\d+)$", "reg": "^$",
    }
    head = {"beg": F.regexp_extract(text, start, 1), "end": F.regexp_extract(text, start, 2), "rest": F.regexp_replace(text, start, "")}
    known = lambda c: F.when(c.rlike(r"^(\d+|\?)$"), "").otherwise(c)  # noqa: E731  a length, or a question mark, says nothing of the bases

    def read(x: Column) -> Column:
        rest, end = x["rest"], F.when(x["end"] == "", x["beg"]).otherwise(x["end"])
        (old, new), (gone,), (cut, put), (more,), (twice,) = (_groups(rest, forms[f], n) for f, n in (("sub", 2), ("del", 1), ("delins", 2), ("ins", 1), ("dup", 1)))
        fits = {f: rest.rlike(form) for f, form in forms.items()}
        of = lambda kind, last, ref, alt: F.struct(F.lit(kind).alias("kind"), x["beg"].alias("beg"), last.alias("end"), F.upper(ref).alias("ref"), F.upper(alt).alias("alt"))
        # in the genome a substitution of several bases ends where these end; a coding one keeps the end that is told
        span = F.coalesce((x["beg"].try_cast("bigint") + F.length(old) - 1).cast("string"), end) if level == "g" else end
        return (
            F.when(x["beg"] == "", F.lit(None))
            .when(fits["sub"] & (F.length(old) <= 1) & (F.length(new) <= 1), of("SNV", x["beg"], known(old), known(new)))
            .when(fits["sub"], of("MNV", F.when(F.length(old) > 1, span).otherwise(end), known(old), known(new)))
            .when(fits["delins"] & (F.length(put) == 1) & (F.length(cut) == 1), of("SNV", x["beg"], known(cut), put))
            .when(fits["delins"], of("MNV", end, known(cut), put))
            .when(fits["del"], of("DEL", end, known(gone), F.lit("")))
            .when(fits["ins"], of("INS", end, F.lit(""), more))
            .when(fits["dup"], of("DUP", end, known(twice), F.lit("")))
            .when(fits["reg"], of("REG", end, F.lit(""), F.lit("")))
        )

    return _or_nulls(bind(head, read), {"kind": "string", "beg": "string", "end": "string", "ref": "string", "alt": "string"})


def parse_genomic(text: Column) -> Column:
    """struct(kind, beg, end, ref, alt) of a genomic change; all null for what has no form.

    kind: SNV, DEL, INS, MNV, DUP or REG.  A deletion and insertion of one base is an SNV.
    """
    return _nucleotides(text, "g", r"\d+")


def parse_coding(text: Column) -> Column:
    """The same for changes of coding sequences, whose places parse_position reads."""
    return _nucleotides(text, "c", r"[*+-]?\d+(?:[+-]\d+)?")


def parse_position(s: Column) -> Column:
    """struct(pos, offset) of n, n+k, n-k, -k (before base 1) and *k or +k (after the last base: pos -1)."""
    whole, base = s.rlike(r"^\d+([+-]\d+)?$"), F.regexp_extract(s, r"^(\d+)", 1)
    shift = F.regexp_extract(s, r"^\d+([+-]\d+)$", 1)
    before, after = s.rlike(r"^-\d+$"), s.rlike(r"^[*+]\d+$")
    digits = F.regexp_extract(s, r"(\d+)$", 1)
    number = lambda c: c.try_cast("int")
    pos = F.when(whole, number(base)).when(before, 1).when(after, -1)
    offset = F.when(whole, F.when(shift == "", 0).otherwise(number(shift))).when(before, -number(digits)).when(after, number(digits))
    return F.struct(pos.cast("int").alias("pos"), offset.cast("int").alias("offset"))


def one_letter(text: Column) -> Column:
    """Amino acids in one-letter code: three-letter names (Ter for a stop) are read as such if all of the text is; other text is put in upper case, a number is no text."""
    names = {v: k for k, v in THREE_LETTERS.items() if len(v) == 3} | {"Ter": "*"}
    parts = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]{2}|\*"), F.lit(0))
    short = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(literal_map(names | {"*": "*"}), x), F.lit("?"))), "")
    return F.when(text.rlike(r"^\d+$"), "").when(text.rlike(r"^(?:[A-Z][a-z]{2}|\*)*[A-Z][a-z]{2}(?:[A-Z][a-z]{2}|\*)*$") & ~short.contains("?"), short).otherwise(F.upper(text))


def three_letters(text: Column) -> Column:
    """One-letter amino acids as three-letter names; a stop is X."""
    return F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.try_element_at(literal_map(THREE_LETTERS), x), x)), "")


def parse_protein(text: Column) -> Column:
    """struct(kind, beg, end, beg_aa, end_aa, ref, alt, stop) of a protein change; all null for what has no form.

    kind: FS (stop: codons to the new stop, if told), DEL, INS, DUP, SNV, MNV, or
    REG, whose ref is a motif with x for any amino acid.  beg_aa and end_aa are
    the amino acids named at the ends; ref and alt what is taken out and put in.
    """
    start = rf"^(?:p\.)?({_AMINO}*?)(\d+)(?:_({_AMINO}*?)(\d+))?"
    forms = {
        "fs": rf"^({_AMINO}*?)fs(?:(?:\*|X|Ter)(\d*)|\?)?$", "del": rf"^del({_AMINO}*|\d+)$", "delins": rf"^del({_AMINO}*|\d+)ins({_AMINO}+)$", "ins": rf"^ins({_AMINO}+)$", "dup": rf"^dup({_AMINO}*|\d+)$",
        "sub": rf"^({_AMINO}*)>({_AMINO}+)$", "same": "^=$", "open": r"^\??$", "alt": rf"^({_AMINO}+)$",
    }
    head = {"beg_aa": one_letter(F.regexp_extract(text, start, 1)), "beg": F.regexp_extract(text, start, 2).try_cast("int"), "end_aa": one_letter(F.regexp_extract(text, start, 3)), "last": F.regexp_extract(text, start, 4).try_cast("int"), "rest": F.regexp_replace(text, start, "")}

    def read(x: Column) -> Column:
        rest, alone = x["rest"], x["last"].isNull()
        fits = {f: rest.rlike(form) for f, form in forms.items()}
        (shifted, stop), (gone,), (cut, put), (more,), (twice,), (old, new), (alt,) = (_groups(rest, forms[f], n) for f, n in (("fs", 2), ("del", 1), ("delins", 2), ("ins", 1), ("dup", 1), ("sub", 2), ("alt", 1)))
        single = lambda c: F.replace(one_letter(c), F.lit("X"), F.lit("*"))
        end = F.when(alone, x["beg"]).otherwise(x["last"])
        end_aa = F.when(alone, x["beg_aa"]).otherwise(x["end_aa"])
        none = F.lit("")

        def of(kind: str, ref: Column, alt: Column, stop: Column | None = None) -> Column:
            return F.struct(F.lit(kind).alias("kind"), x["beg"].alias("beg"), end.alias("end"), x["beg_aa"].alias("beg_aa"), end_aa.alias("end_aa"), ref.alias("ref"), alt.alias("alt"), (F.lit(None).cast("int") if stop is None else stop).alias("stop"))

        return (
            F.when(x["beg"].isNull(), F.lit(None))
            .when(fits["fs"], of("FS", x["beg_aa"], single(shifted), stop.try_cast("int")))
            .when(fits["delins"] & alone & (F.length(one_letter(put)) == 1), of("SNV", x["beg_aa"], single(put)))
            .when(fits["delins"], of("MNV", one_letter(cut), one_letter(put)))
            .when(fits["del"], of("DEL", one_letter(gone), none))
            .when(fits["ins"], of("INS", none, one_letter(more)))
            .when(fits["dup"], of("DUP", one_letter(twice), none))
            .when(fits["sub"], of("MNV", one_letter(old), one_letter(new)))
            .when(fits["same"] & alone, of("SNV", x["beg_aa"], x["beg_aa"]))
            .when(fits["open"], of("REG", none, none))
            .when(fits["alt"] & alone, of("SNV", x["beg_aa"], single(alt)))
            .when(fits["alt"], of("REG", F.upper(alt), none))
        )

    return _or_nulls(bind(head, read), {"kind": "string", "beg": "int", "end": "int", "beg_aa": "string", "end_aa": "string", "ref": "string", "alt": "string", "stop": "int"})


def split_identifier(text: Column) -> Column:
    """struct(tok, change, level) of tok:change; level is g, c or p by the prefix, or null; a text without a colon is a tok (GENE)."""
    at = F.instr(text, ":")
    change = F.when(at > 0, F.trim(F.substr(text, at + 1)))
    return F.struct(F.trim(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)).alias("tok"), change.alias("change"), F.nullif(F.regexp_extract(change, r"^([gcp])\.", 1), F.lit("")).alias("level"))


def normalize_chromosome(c: Column) -> Column:
    """With or without chr: 23, 24, 25 and MT are X, Y, M and M; bare digits, X, Y and M get the prefix chr; other names stay."""
    bare = F.regexp_replace(c, r"^chr(?=(\d+|MT)$)", "")
    plain = F.when(bare == "23", "X").when(bare == "24", "Y").when(bare.isin("25", "MT"), "M").otherwise(bare)
    return F.when(plain.rlike(r"^(\d+|X|Y|M)$"), F.concat(F.lit("chr"), plain)).otherwise(plain)


def dbsnp_chromosome(c: Column) -> Column:
    """The same without prefix, M as MT."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "23", "X").when(bare == "24", "Y").when(bare.isin("25", "M", "MT"), "MT").otherwise(bare)
