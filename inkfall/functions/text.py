"""Text expressions that follow Unicode rules of white space, words and code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that str.isspace() accepts, as the inside of a character class.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACES}]"
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Unicode character classes, ^ and $ at each line, only a line feed ends a line.
LINES = "(?Umd)"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARACTERS))


def wide_space(pattern: str) -> str:
    r"""A pattern with \s in and out of character classes as the 29 code points."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACES if inside else SPACE)
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or two[:1] == "[") and two[:1] != "]"
            out.append(two[:1])
            i += 1
    return "".join(out)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))
