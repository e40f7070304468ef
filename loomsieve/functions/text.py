"""Text projections and predicates as Column expressions (JVM side, no Python).

``(?U)`` gives Java's regular expressions Unicode classes for ``\\w`` and ``\\s``.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM = r"\p{IsAlphabetic}\p{N}"


def field(df: DataFrame, name: str) -> Column:
    """A top-level string column; null where it is absent or of another type."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(kinds.get(name), T.StringType):
        return F.col(f"`{name}`")
    return F.lit(None).cast("string")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def strip_punctuation(c: Column) -> Column:
    """Each character that is neither word nor space becomes one space."""
    return F.regexp_replace(c, r"(?U)[^\w\s]", " ")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    """A few texts at a time are Python objects."""
    some = lambda at: [t if t is None else unicodedata.normalize("NFKD", t) for t in texts.slice(at, 64).to_pylist()]
    return pa.chunked_array([pa.array(some(at), pa.string()) for at in range(0, len(texts), 64)], pa.string()).combine_chunks()


def nfkd(c: Column) -> Column:
    """Compatibility decomposition; Spark has no built-in for it. ASCII stays as it is and in the JVM."""
    return F.coalesce(_nfkd(F.when(F.char_length(c) < F.octet_length(c), c)), c)


@dataclass(frozen=True)
class Normalizer:
    """Steps of text normalization, always in this order."""

    decompose: bool = False
    lower: bool = True
    punctuation: bool = True
    spaces: bool = True

    @classmethod
    def aggressive(cls) -> Normalizer:
        return cls(decompose=True)

    @classmethod
    def balanced(cls) -> Normalizer:
        return cls()

    @classmethod
    def conservative(cls) -> Normalizer:
        return cls(punctuation=False)

    def __call__(self, c: Column) -> Column:
        c = nfkd(c) if self.decompose else c
        c = lowercase(c) if self.lower else c
        c = strip_punctuation(c) if self.punctuation else c
        return collapse_spaces(c) if self.spaces else c


#: All of Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def fold_key(c: Column) -> Column:
    """Exact-dedup normalization: outer Unicode white space off, lower case, inner spaces kept. A trim
    looks at the ends only, where a pattern tries each run of spaces."""
    return F.lower(F.btrim(c, F.lit(WHITE)))


def words(c: Column) -> Column:
    """Lower-case words without outer punctuation; empty ones are left out. One pass finds each run of
    non-spaces from its first to its last letter or digit."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?U)[{ALNUM}](?:\S*[{ALNUM}])?"), F.lit(0)), F.lower)


def length_ok(c: Column, least: int | None = None, most: int | None = None) -> Column:
    """Inclusive bounds on UTF-8 bytes; null fails."""
    size = F.octet_length(c)
    ok = size.isNotNull()
    if least is not None:
        ok = ok & (size >= least)
    if most is not None:
        ok = ok & (size <= most)
    return F.coalesce(ok, F.lit(False))


UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def format_bytes(n: int) -> str:
    for unit in ("TB", "GB", "MB", "KB"):
        if n >= UNITS[unit]:
            return f"{n / UNITS[unit]:.2f} {unit}"
    return f"{n} B"


def parse_bytes(s: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?B)?\s*", s, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a size: {s!r}")
    return int(float(m[1]) * UNITS[(m[2] or "B").upper()])


def format_count(n: int) -> str:
    """1234567 -> 1.2M, 3400 -> 3.4K."""
    for least, unit in ((1_000_000, "M"), (1_000, "K")):
        if n >= least:
            return f"{n / least:.1f}{unit}"
    return str(n)


def format_thousands(n: int) -> str:
    return f"{n:,}"
