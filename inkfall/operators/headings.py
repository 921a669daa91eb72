"""Chunks of Markdown by its headers as folds of column expressions, without Python.

A fold over the lines carries the open fence, the stack of open headers and where the current paragraph
began. Whether two paragraphs that follow each other are one section depends on these two alone, so
sections need no state. A last fold finds where each section stands, from the end of the one before it on.

Folds go over blocks of BLOCK items, so that what they give is copied a block at a time and a text takes
time in proportion to its lines. Nothing is shuffled: a row's lines stay in its row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfall.functions.text import SPACE
from inkfall.operators.folds import _bound, _strip, quoted

BLOCK = 256
#: What a line loses: control, format, surrogate and private code points, and separators but the blank.
#: Code points that are not assigned stay, so that a newer script is not lost to an older JVM.
UNPRINTED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Z}&&[^ ]]"

_PATH = "array<struct<level: int, name: string, title: string>>"
_PARAGRAPH = f"struct<first: int, last: int, path: {_PATH}>"
_CHUNK = "struct<text: string, metadata: string, char_start: int, char_end: int>"


def _scan(items: str, start: str, kind: str, step: str, last: str = "") -> str:
    """What a fold gives item by item: `step` is SQL of named_struct('s', state, 'out', array) from a and x, `last` of an array from o.s."""
    blocks = f"transform(sequence(0, cast(floor(greatest(size({items}) - 1, 0) / {BLOCK}) as int)), k -> slice({items}, k * {BLOCK} + 1, {BLOCK}))"
    within = f"aggregate(b, named_struct('s', o.s, 'out', cast(array() as array<{kind}>)), (a, x) -> {step})"
    joined = _bound(within, "n", "named_struct('s', n.s, 'out', array_append(o.out, n.out))")
    end = f"concat(flatten(o.out), {last})" if last else "flatten(o.out)"
    return f"aggregate({blocks}, named_struct('s', {start}, 'out', cast(array() as array<array<{kind}>>)), (o, b) -> {joined}, o -> {end})"


def _head(line: str, headers: list[tuple[str, str]]) -> str:
    """The longest mark that a line begins with as a word: its level, its name as JSON, and the title."""
    cases = [
        f"when {line} = {quoted(mark)} or startswith({line}, {quoted(mark + ' ')}) then struct({mark.count('#')} as level, {quoted(json.dumps(name, ensure_ascii=False))} as name, {_strip(f'substring({line}, {len(mark) + 1})')} as title)"
        for mark, name in sorted(headers, key=lambda h: -len(h[0]))
    ]
    return f"case {' '.join(cases)} end"


def _paragraphs(lines: str, headers: list[tuple[str, str]], bare: bool) -> str:
    """Runs of lines without a blank one or a header between them, as places of lines, with the open headers."""
    items = f"transform({lines}, (l, i) -> struct(l as line, i + 1 as i, {_head('l', headers)} as head))"
    opens = "startswith(x.line, '~~~') or startswith(x.line, '```') and instr(substring(x.line, 4), '```') = 0"
    fence = f"case when a.s.fence <> '' then if(startswith(x.line, a.s.fence), '', a.s.fence) when {opens} then substring(x.line, 1, 3) else '' end"
    closes, header = "(f = '' and (x.head is not null or x.line = ''))", "(f = '' and x.head is not null)"
    path = f"if({header}, array_append(filter(a.s.path, p -> p.level < x.head.level), x.head), a.s.path)"
    begun = f"case when {closes} then if({header} and {'false' if bare else 'true'}, x.i, 0) when a.s.start = 0 then x.i else a.s.start end"
    out = f"if({closes} and a.s.start > 0, array_append(a.out, struct(a.s.start as first, x.i - 1 as last, a.s.path as path)), a.out)"
    step = _bound(fence, "f", f"named_struct('s', named_struct('fence', f, 'path', {path}, 'start', {begun}), 'out', {out})")
    rest = f"if(o.s.start > 0, array(struct(o.s.start as first, size({lines}) as last, o.s.path as path)), cast(array() as array<{_PARAGRAPH}>))"
    return _bound(items, "w", _scan("w", f"named_struct('fence', '', 'path', cast(array() as {_PATH}), 'start', 0)", _PARAGRAPH, step, rest))


def _sections(lines: str, paragraphs: str, bare: bool) -> str:
    """Paragraphs under one header path together; a header alone goes with the deeper one after it."""
    before, this = f"element_at({paragraphs}, k - 1)", f"element_at({paragraphs}, k)"
    lone = "false" if bare else f"size({before}.path) < size({this}.path) and startswith(element_at({lines}, {before}.last), '#')"
    numbers = f"if(size({paragraphs}) = 0, cast(array() as array<int>), sequence(1, size({paragraphs})))"
    starts = f"filter({numbers}, k -> case when k = 1 then true else not ({before}.path = {this}.path or {lone}) end)"
    end = f"coalesce(get(starts, j + 1) - 1, size({paragraphs}))"
    text = f"array_join(transform(slice({paragraphs}, k, {end} - k + 1), p -> array_join(slice({lines}, p.first, p.last - p.first + 1), '\\n')), '  \\n')"
    return _bound(starts, "starts", f"transform(starts, (k, j) -> struct({text} as text, element_at({paragraphs}, {end}).path as path))")


def _in_words(rest: str) -> str:
    """Where the words v.said stand in a rest of the text with any white space between them, or null.

    They are looked for with each run of white space as one blank; what the runs before a place have over
    one character is what it lies further on.
    """
    blanks = lambda t: f"(length({t}) - length(replace({t}, ' ', '')))"
    at = lambda place, n: f"{place} + length(array_join(slice(c.runs, 1, {n}), '')) - {n}"
    place = f"named_struct('char_start', a.s + {at('h - 1', 'q')}, 'char_end', a.s + {at('h - 1 + length(v.said)', '(q + v.gaps)')})"
    counted = _bound(blanks("substring(c.flat, 1, h - 1)"), "q", place)
    found = _bound("instr(c.flat, v.said)", "h", f"if(h = 0, null, {counted})")
    runs = quoted(f"{SPACE}+")
    return _bound(rest, "y", _bound(f"struct(regexp_replace(y, {runs}, ' ') as flat, regexp_extract_all(y, {runs}, 0) as runs)", "c", found))


def _placed(text: str, sections: str, bare: bool) -> str:
    """Sections with metadata and places: as they are, else with any white space between their words, else by length."""
    near, far = f"substring({text}, a.s + 1, 2 * length(x.text) + 1000)", f"substring({text}, a.s + 1)"
    by_length = "named_struct('char_start', a.s, 'char_end', a.s + length(x.text))"
    words = f"filter(split(x.text, {quoted(f'{SPACE}+')}, -1), z -> z <> '')"
    said = _bound(words, "z", "struct(array_join(z, ' ') as said, greatest(size(z) - 1, 0) as gaps)")
    loose = _bound(said, "v", f"if(v.said = '', {by_length}, coalesce({_in_words(near)}, {_in_words(far)}, {by_length}))")
    exact = "named_struct('char_start', e - 1, 'char_end', e - 1 + length(x.text))"
    place = _bound(f"locate(x.text, {text}, a.s + 1)", "e", f"if(e > 0, {exact}, {loose})")
    escaped = r"replace(replace(p.title, '\\', '\\\\'), '\"', '\\\"')"
    fields = f"array_join(transform(x.path, p -> concat(',', p.name, ':\"', {escaped}, '\"')), '')"
    metadata = f"concat({quoted(json.dumps({'strip_headers': bare}, separators=(',', ':'))[:-1])}, {fields}, '}}')"
    chunk = f"struct(x.text as text, {metadata} as metadata, g.char_start as char_start, g.char_end as char_end)"
    return _scan(sections, "0", _CHUNK, _bound(place, "g", f"named_struct('s', g.char_end, 'out', array_append(a.out, {chunk}))"))


def markdown_sections(text_col: str, headers: list[tuple[str, str]], bare: bool) -> Column:
    """array<struct<text, metadata, char_start, char_end>> of a text's sections; none of a null or blank one.

    Names of headers must differ.
    """
    if len({name for _, name in headers}) < len(headers):
        raise ValueError("names of headers must differ")
    lines = f"transform(split(t, '\\n', -1), l -> regexp_replace({_strip('l')}, {quoted(UNPRINTED)}, ''))"
    within = _bound(_paragraphs("ls", headers, bare), "ps", _bound(_sections("ls", "ps", bare), "ss", _placed("t", "ss", bare)))
    column = "`" + text_col.replace("`", "``") + "`"
    return F.expr(_bound(f"coalesce({column}, '')", "t", _bound(lines, "ls", within)))
