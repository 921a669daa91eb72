"""Splitting of texts as folds of column expressions, without Python.

A text is parted at one separator after another. The pieces of one separator are merged by one fold,
whose state is a window of neighbours: where the next piece does not fit, the window is a chunk and the
end of it that the overlap allows stays. A piece as large as a chunk closes the window and is split at
the finer separators, which is the same expression one level down. Where no separator is left the text
is cut into slices. A second fold finds where each chunk stands.

States hold a window, the chunks so far and a stretch of text as long as a few chunks, and never the
whole text, so a long text takes time in proportion to its length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfall.functions.text import SPACE_CHARACTERS

_NO_STRINGS, _NO_RAW = "cast(array() as array<string>)", "cast(array() as array<struct<text: string, at: int>>)"
_NO_PLACED = "cast(array() as array<struct<text: string, char_start: int, char_end: int>>)"
_FAR = 2147483647


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _strip(text: str) -> str:
    return f"trim(BOTH {quoted(SPACE_CHARACTERS)} FROM {text})"


def _bound(value: str, name: str, use: str) -> str:
    """`use`, in which `name` is the value, computed once. What it gives is copied, so it should be small."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _slices(text: str, size: int, overlap: int) -> str:
    """Every size - overlap characters a slice of `size`, up to the one that reaches the end."""
    step = max(1, size - overlap)
    n = f"if(size(b) > 0, (size(b) - 1) * {step} + length(element_at(b, -1)), 0)"
    used = f"slice(b, 1, cast(floor((greatest({n} - {size}, 0) + {step - 1}) / {step}) as int) + 1)"
    cut = f"substring(array_join(slice(b, i + 1, {-(-size // step)}), ''), 1, {size})"
    return _bound(f"regexp_extract_all({text}, '(?s).{{1,{step}}}', 0)", "b", f"transform({used}, (x, i) -> struct({cut} as text, cast(i * {step} as int) as at))")


def _raw(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> str:
    """Chunks with the white space around them and the place of each; they cover the text without gaps.

    The state is a window of pieces with its length, where the next piece stands, and the chunks so far.
    """
    first, *finer = separators
    if first == "":
        return _slices(text, size, overlap)
    s, p = f"s{len(finer)}", f"p{len(finer)}"
    state = "named_struct('window', {}, 'total', {}, 'at', {}, 'out', {})".format
    parts = f"split({text}, {quoted(re.escape(first))}, -1)"
    pieces = f"filter(transform({parts}, (x, i) -> if(i = 0, x, concat({quoted(first)}, x))), x -> x <> '')"
    closed = f"if(size({s}.window) > 0, array_append({s}.out, struct(array_join({s}.window, '') as text, {s}.at - {s}.total as at)), {s}.out)"
    at = f"{s}.at + length({p})"
    below = f"transform({_raw(p, size, overlap, tuple(finer))}, c -> struct(c.text as text, c.at + {s}.at as at))"
    large = state(_NO_STRINGS, "0", at, f"concat({closed}, {below})")
    # How many pieces at the end of the window the next chunk begins with, and their length.
    count = "named_struct('kept', {}, 'total', {}, 'fits', {})".format
    room = f"least({overlap}, {size} - length({p}))"
    add = f"if(k.fits and k.total + length(x) <= {room}, {count('k.kept + 1', 'k.total + length(x)', 'true')}, {count('k.kept', 'k.total', 'false')})"
    end = f"aggregate(reverse({s}.window), {count('0', '0', 'true')}, (k, x) -> {add})"
    moved = state(f"array_append(slice({s}.window, size({s}.window) - {end}.kept + 1, size({s}.window)), {p})", f"{end}.total + length({p})", at, closed)
    longer = state(f"array_append({s}.window, {p})", f"{s}.total + length({p})", at, f"{s}.out")
    step = f"case when length({p}) >= {size} then {large} when size({s}.window) > 0 and {s}.total + length({p}) > {size} then {moved} else {longer} end"
    return f"aggregate({pieces}, {state(_NO_STRINGS, '0', '0', _NO_RAW)}, ({s}, {p}) -> {step}, {s} -> {closed})"


def _placed(text: str, raw: str, overlap: int) -> str:
    """Stripped chunks with their places: each is looked for from the end of the one before it, less the overlap, on.

    `recent` is the text from `base` to the end of the chunk before, and grows by what a raw chunk
    adds. A chunk stands in it from the cursor on, at the latest where it was cut. Only what later
    searches are likely to need is kept; where one begins before that, it is taken from the text. The
    last chunk stays apart and joins the others one step later, so that what is bound stays small.
    """
    last = "named_struct('base', {}, 'recent', {}, 'cursor', {}, 'text', {}, 'start', {})".format
    joined = "if(s.last.text <> '', array_append(s.out, struct(s.last.text as text, s.last.start as char_start, s.last.start + length(s.last.text) as char_end)), s.out)"
    grown = f"concat(s.last.recent, substring(r.text, s.last.base + length(s.last.recent) - r.at + 1, {_FAR}))"
    cursor = f"greatest(0, f + length(x.text) - {overlap})"
    base = f"greatest(0, f + length(x.text) - {5 * overlap})"
    near = f"if({base} >= s.last.base, substring(x.recent, {base} - s.last.base + 1, {_FAR}), substring({text}, {base} + 1, s.last.base + length(x.recent) - {base}))"
    found = _bound("s.last.base + locate(x.text, x.recent, s.last.cursor - s.last.base + 1) - 1", "f", last(base, near, cursor, "x.text", "f"))
    search = f"if(x.text = '', {last('s.last.base', 'x.recent', 's.last.cursor', 'x.text', '0')}, {found})"
    step = f"named_struct('last', {_bound(f'struct({grown} as recent, {_strip("r.text")} as text)', 'x', search)}, 'out', {joined})"
    start = f"named_struct('last', {last('0', quoted(''), '0', quoted(''), '0')}, 'out', {_NO_PLACED})"
    return f"aggregate({raw}, {start}, (s, r) -> {step}, s -> {joined})"


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> str:
    """SQL of array<struct<text, char_start, char_end>> from SQL of a text: its chunks of up to `size`
    characters, stripped, blanks left out.

    The last separator must be empty, and size greater than 1.
    """
    return _bound(f"coalesce({text}, '')", "t", _placed("t", _raw("t", size, overlap, separators), overlap))


def recursive(text_col: str, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    return F.expr(recursive_chunks(f"`{text_col}`", size, overlap, separators))
