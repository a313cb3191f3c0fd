"""Expressions over aligned sequences, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop codons and the score of each amino-acid letter.
STOPS = ("TAA", "TAG", "TGA")
HYDROPHOBICITY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}


def normalised(seq: Column, dna: bool = False) -> Column:
    """Without white space, in upper case, optionally with T for U."""
    text = F.upper(F.regexp_replace(seq, r"\s+", ""))
    return F.translate(text, "U", "T") if dna else text


def codons(seq: Column) -> Column:
    """3-mers of the usable length; the empty array below three symbols."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seq, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def ambiguous_codon_fraction(seq: Column) -> Column:
    """Share of codons with a symbol outside ACGT; 1 without codons."""
    all_ = codons(seq)
    return F.when(F.size(all_) == 0, F.lit(1.0)).otherwise(F.size(F.filter(all_, lambda c: c.rlike("[^ACGT]"))) / F.size(all_))


def has_internal_stop(seq: Column) -> Column:
    """A stop codon before the last codon."""
    all_ = codons(seq)
    return F.when(F.size(all_) < 2, F.lit(False)).otherwise(F.exists(F.slice(all_, 1, F.size(all_) - 1), lambda c: c.isin(*STOPS)))


def in_frame(seq: Column) -> Column:
    return F.length(seq) % 3 == 0


def frame_length(n: Column) -> Column:
    """Below 3: 3, else rounded down to a multiple of 3."""
    return F.greatest(F.lit(3), n - n % 3)


def part(seq: Column, start: Column, end: Column) -> Column:
    """Symbols start to end, from 0 and half open; null where the range is not inside the sequence."""
    ok = (start >= 0) & (end > start) & (end <= F.length(seq))
    return F.when(ok, F.substring(seq, start + 1, end - start))


def taxon(name: Column) -> Column:
    """Cut at the first "|" and then "/", trimmed, inner white space joined by "_", in lower case."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.lower(F.regexp_replace(strip(F.split_part(strip(F.split_part(name, F.lit("|"), F.lit(1))), F.lit("/"), F.lit(1))), r"\s+", "_"))


def identifier(text: Column, default: str = "gene") -> Column:
    """Letters, digits and "_-." stay, others become "_"; "._" are trimmed from the ends."""
    kept = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def column_name(text: Column, default: str = "baseline") -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def token(text: Column, default: str = "unknown") -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def status(state: Column, reason: Column, missing: str = "not_run") -> Column:
    """OK, SKIP_<reason> or FAIL_<reason>."""
    st = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    why = token(reason, missing)
    skipped = st.startswith("SKIP") | st.startswith("DROP")
    return F.when(st == "OK", "OK").when(st == "", f"SKIP_{missing}").when(skipped, F.concat(F.lit("SKIP_"), why)).otherwise(F.concat(F.lit("FAIL_"), why))


def date_of(text: Column) -> Column:
    """A date of three precisions; what follows "T" is cut and missing parts are the first of their kind."""
    day = F.split_part(text, F.lit("T"), F.lit(1))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(day, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")))


def in_dates(date: Column, low: str | None, high: str | None) -> Column:
    """Both bounds inclusive and optional; a null date fails as soon as one is set."""
    inside = F.lit(True)
    if low:
        inside = inside & (date >= F.lit(low).cast("date"))
    if high:
        inside = inside & (date <= F.lit(high).cast("date"))
    return F.coalesce(inside, F.lit(False))


def month_of(text: Column) -> Column:
    return F.when((F.length(text) >= 7) & (F.substring(text, 5, 1) == "-"), F.substring(text, 1, 7)).otherwise("unknown")


def field_text(value: Column) -> Column:
    """A value as a field of a tab-separated file: nulls empty, tabs and line feeds as spaces."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"[\t\n]", " "), F.lit(""))


def record_hash(*columns: str) -> Column:
    """A hash of named values in the order of their names; nulls are empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns))), 256)
