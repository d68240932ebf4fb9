"""Column functions on bases and qualities.

Bases are strings.  Qualities are strings of phred+33 characters, null where a read has
none (FASTA).  All are Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenstrand.config import Config

CALLED = "ACGTUacgtu"
#: Letters that stand for more than one base.
IUPAC = "RYSWKMBDHVryswkmbdhv"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(bases) -> Column:
    return F.translate(F.reverse(_col(bases)), "ACGTUacgtu", "TGCAAtgcaa")


def to_acgt(bases) -> Column:
    """Upper case with U as T, for k-mers."""
    return F.translate(F.upper(_col(bases)), "U", "T")


def numbers(quals) -> Column:
    """Qualities as an array of numbers."""
    q = _col(quals)
    return F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.ascii(F.substring(q, i, F.lit(1))) - 33)).when(q.isNotNull(), F.array().cast("array<int>"))


def _each(bases: Column, quals: Column, value) -> Column:
    """A quality string from value(called, quality character code) at every place."""
    places = F.sequence(F.lit(1), F.length(bases))
    one = lambda i: F.char(value(F.lit(CALLED).contains(F.substring(bases, i, F.lit(1))), F.ascii(F.substring(quals, i, F.lit(1)))).cast("long"))
    made = F.when(F.length(bases) > 0, F.concat_ws("", F.transform(places, one))).otherwise("")
    return F.when(quals.isNotNull(), made)


def normalize_quality(bases, quals, offset: int = 33) -> Column:
    """Qualities as phred+33: at least 2 for called bases, 0 for others."""
    b, q = _col(bases), _col(quals)
    return _each(b, q, lambda called, c: F.when(called, F.greatest(c - offset, F.lit(2)) + 33).otherwise(33))


def cap_quality(bases, quals, low: int = 2, high: int = 50) -> Column:
    """Qualities of called bases within low..high, of others 0."""
    b, q = _col(bases), _col(quals)
    return _each(b, q, lambda called, c: F.when(called, F.least(F.greatest(c - 33, F.lit(low)), F.lit(high)) + 33).otherwise(33))


def requality(quals, offset: int) -> Column:
    """phred+33 qualities with another offset."""
    q = _col(quals)
    if offset == 33:
        return q
    chars = "".join(chr(33 + i) for i in range(94))
    return F.translate(q, chars, "".join(chr(min(offset + i, 126)) for i in range(94)))


def clean_bases(bases, c: Config) -> Column:
    """Bases after the cleanup flags, in their order; the junk mode comes last."""
    out = _col(bases)
    if c.u_to_t:
        out = F.translate(out, "Uu", "Tt")
    if c.lower_to_n:
        out = F.translate(out, LOWER, "N" * 26)
    elif c.to_upper:
        out = F.translate(out, LOWER, UPPER)
    if c.fix_junk_and_iupac or (c.dot_dash_x_to_n and c.iupac_to_n):
        out = F.regexp_replace(F.translate(out, "acgtUu", "ACGTTT"), "[^ACGTN]", "N")
    else:
        if c.iupac_to_n:
            out = F.translate(out, IUPAC, "N" * len(IUPAC))
        if c.dot_dash_x_to_n:
            out = F.translate(out, ".-Xxn", "NNNNN")
    if c.junk == "fix":
        out = F.regexp_replace(out, _JUNK, "N")
    elif c.junk == "crash":
        out = F.when(out.rlike(_JUNK), F.raise_error(F.concat(F.lit("a read holds characters that are no bases: "), out)).cast("string")).otherwise(out)
    return out


_JUNK = f"[^{CALLED}{IUPAC}Nn.\\-Xx]"


def has_junk(bases) -> Column:
    return _col(bases).rlike(_JUNK)


def prepare(bases, quals, c: Config) -> tuple[Column, Column]:
    """Cleaned bases and normalised qualities, in the order of reading: offset, cleanup, caps."""
    q = normalize_quality(bases, quals, c.qin)
    b = clean_bases(bases, c)
    return b, cap_quality(b, q, c.min_called_quality, c.max_called_quality) if c.change_quality else q


def fake_quality(bases, quals, fake: int = 30) -> Column:
    """The qualities, or for reads without any `fake` at called bases and 0 elsewhere."""
    b = _col(bases)
    made = F.regexp_replace(F.regexp_replace(b, f"[{CALLED}]", "\u0001"), "[^\u0001]", "!")
    return F.coalesce(_col(quals), F.translate(made, "\u0001", chr(33 + fake)))


def correct_probability(quality) -> Column:
    """The chance that a base of this quality is right; 0 for quality 0."""
    return F.lit(1.0) - F.pow(F.lit(10.0), -_col(quality) / 10)


def gc_fraction(bases) -> Column:
    b = _col(bases)
    gc = F.length(b) - F.length(F.translate(b, "GCgc", ""))
    acgt = F.length(b) - F.length(F.translate(b, CALLED, ""))
    return F.when(acgt > 0, gc / acgt).otherwise(F.lit(0.0))


def barcode(name) -> Column:
    """What follows the last colon of a read's name, or NONE."""
    n = _col(name)
    return F.when(n.contains(":") & (F.substring_index(n, ":", -1) != ""), F.substring_index(n, ":", -1)).otherwise("NONE")


def renamed(numeric_id, d1, d2=None, e1=None, e2=None) -> Column:
    """id=N,d1=A[,d2=B][,e1=C[,e2=D]] (our format)."""
    parts = [F.concat(F.lit("id="), _col(numeric_id).cast("string")), F.concat(F.lit("d1="), _col(d1).cast("string"))]
    for name, value in (("d2", d2), ("e1", e1), ("e2", e2)):
        if value is not None:
            parts.append(F.concat(F.lit(f"{name}="), _col(value).cast("string")))
    return F.concat_ws(",", *parts)
