"""HTML tables, a sentence for each row.

Each document's tables are read in one call: the heading gives context and column names, empty cells
take the value above, and references to other rows are spelled out. Both go from row to row and look
rows up by number, so they are done where a table is held as lists. Then each row is told by a template;
table_rows.py does that by column expressions, a row of a table being a row of the DataFrame.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkfall.operators import table_rows
from inkfall.operators.html import Element, cell_text, parse

# Words by which a first column is known to name its rows.
KEY_WORDS = ("id", "编号", "序号", "名称", "姓名", "项目", "指标", "层位", "深度", "地层", "样品", "点位", "编号/id", "id/编号")
# Forms of numbers and of references to other rows.
NUMBER = re.compile(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
NUMBER_WITH_UNIT = re.compile(r"^(-?\d+(?:\.\d+)?)\s*[a-zA-Z一-鿿]+$")
SAME_ABOVE = re.compile(r"^(同[上]|同上|同前|如上)$")
SAME_AS_ROW = re.compile(r"^(?:特征)?同\s*(\d+)\s*(?:层|行|排)?$")
SEE_ROW = re.compile(r"^[见参][见考]?(?:第)?\s*(\d+)\s*(?:层|行|排)?.*$")
REFERS = frozenset("同如特见参")  # what references begin with


@dataclass
class Table:
    index: int
    context: str
    headers: list[str]
    cells: list[list[str]]  # by place
    named: list[dict[str, str]]  # by header; of headers that repeat, the last cell counts


def looks_like_header(cells: list[str]) -> bool:
    """Two cells or more, each of 2 to 15 characters without a digit."""
    words = [c.strip() for c in cells]
    return len(words) > 1 and all(2 <= len(w) <= 15 and not re.search(r"\d", w) for w in words)


def _repeated(text: str, times: int, form: str) -> list[str]:
    return [form.format(text, i + 1) for i in range(times)] if times > 1 else [text] * times


def _heading(thead: Element | None) -> tuple[str, list[str]]:
    """Context from rows whose cells all span columns, names from the last other row."""
    rows = list(thead.walk("tr")) if thead else []
    context: list[str] = []
    names: list[str] = []
    for row in rows:
        cells = [(c.words(), c.span("colspan")) for c in row.walk("th", "td")]
        if cells and all(n > 1 for _, n in cells):
            context += [text for text, _ in cells]
        elif cells:
            names = [name for text, n in cells for name in _repeated(text, n, "{}[{}]")]
    if not names and rows:
        names = [name for c in rows[-1].walk("th", "td") for name in _repeated(c.words(), c.span("colspan"), "{}-{}")]
    return "；".join(context), names


def _body(table: Element) -> list[Element]:
    body, head = table.first("tbody"), table.first("thead")
    if body is not None:
        return list(body.walk("tr"))
    top = list(head.walk("tr")) if head is not None else []
    shapes, heading = {row.shape() for row in top}, {row.same() for row in top}
    return [row for row in table.walk("tr") if row.shape() not in shapes or row.same() not in heading]


def _read(table: Element, index: int, skip_empty: bool) -> Table | None:
    context, headers = _heading(table.first("thead"))
    spanned, cells, width = False, [], len(headers)
    named_by: list[str] | None = headers or None
    for row in _body(table):
        own = list(row.walk("td", "th"))
        if not own:
            continue
        if all(c.name == "th" for c in own):
            if not headers and not named_by:
                for c in own:
                    text, n = c.words(), c.span("colspan")
                    headers += _repeated(text, n, "{}[{}]")
                    if n > 1:
                        spanned, context = True, context or text
                width, named_by = len(headers), headers or None
            continue
        if named_by is None:
            width = sum(c.span("colspan") for c in own)
            headers = named_by = [f"列{i + 1}" for i in range(width)]
        line = [text for c in own for text in [cell_text(c)] * c.span("colspan")]
        line = (line + [""] * width)[:width]
        if not (skip_empty and all(not v.strip() for v in line)):
            cells.append(line)
    named = [dict(zip(headers, line, strict=True)) for line in cells]
    if spanned and named and looks_like_header(list(named[0].values())):
        headers = list(named[0].values())
        values = [list(n.values()) for n in named[1:]]
        named = [{h: v[j] if j < len(v) else "" for j, h in enumerate(headers)} for v in values]
        cells = cells[1:]
    if not named:
        return None
    return Table(index, context, headers, cells, named)


def fill_down(table: Table) -> Table:
    """Empty cells take the value above."""
    for column, header in enumerate(table.headers):
        above = ""
        for line, by_name in zip(table.cells, table.named, strict=True):
            if by_name.get(header, "") or not above:
                above = by_name.get(header, "")
                continue
            by_name[header] = above
            if column < len(line):
                line[column] = above
    return table


def parsed_tables(text: str, skip_empty: bool = True) -> list[Table]:
    """All tables of a text as they stand, nested ones too; a table that can't be read is left out."""
    out = []
    for index, element in enumerate(parse(text).walk("table")):
        try:
            table = _read(element, index, skip_empty)
        except ValueError:  # a span that is no number
            continue
        if table:
            out.append(table)
    return out


def read_tables(text: str, skip_empty: bool = True) -> list[Table]:
    """All tables of a text, with empty cells filled."""
    return [fill_down(table) for table in parsed_tables(text, skip_empty)]


def _resolved(table: Table, text: str, row: int, column: int) -> str:
    """The cell with what it refers to: the row above, or a row by its number."""

    def value(at: int) -> str:
        return table.cells[at][column].strip() if 0 <= at < len(table.cells) and column < len(table.cells[at]) else ""

    word = text.strip()
    if word[:1] not in REFERS:
        return text
    if SAME_ABOVE.match(word):
        above = value(row - 1) if row else ""
        return f"{text}（即：{above}）" if above else text
    same, see = SAME_AS_ROW.match(word), SEE_ROW.match(word)
    found = same or see
    if not found:
        return text
    number = found[1].lstrip("0０")
    at = int(number or 0) - 1 if len(number) < 19 else -1  # int() refuses thousands of digits
    target = value(at)
    if not target:
        return text
    name = table.cells[at][0].strip()
    if same:
        return f"{text}（即{f'（{name}行）' if name else ''}：{target}）"
    return f"{text}（参考{f'{name}行' if name else ''}：{target}）"


def resolve(table: Table) -> Table:
    """Spell references out, row by row, so that later ones see what earlier ones became."""
    if len(table.cells) > 1:
        for r, line in enumerate(table.cells):
            for c, text in enumerate(line):
                new = _resolved(table, text, r, c)
                if new != text:
                    line[c] = new
                    if c < len(table.headers):
                        table.named[r][table.headers[c]] = new
    return table


def names_rows(header: str) -> bool:
    word = header.lower().replace(" ", "").replace("/", "")
    return any(k in word for k in KEY_WORDS)


def row_text(table: Table, row: dict[str, str], by_key: bool) -> str:
    values = [row.get(h, "").strip() for h in table.headers]
    key = values[0] if by_key else ""
    told = "，".join(f"{h}为{v.removesuffix('。')}" for i, (h, v) in enumerate(zip(table.headers, values, strict=True)) if v and not (by_key and i == 0))
    inside = f"{table.context}中" if table.context else ""
    if key and told:
        return f"{f'在{inside}，' if inside else ''}关于【{key}】的记录显示：{told}。"
    if key:
        return f"{f'在{inside}中，' if inside else ''}存在记录【{key}】。"
    return f"{f'{inside}，' if inside else ''}{told}。" if told else ""


def numbers(row: dict[str, str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for header, value in row.items():
        word = value.strip()
        if NUMBER.match(word):
            if "." in word:
                out[header] = float(word)
            elif "e" not in word.lower():
                out[header] = int(word)
        elif found := NUMBER_WITH_UNIT.match(word):
            out[header] = float(found[1])
    return out


def table_chunks(text: str, references: bool = True, style: str = "default", skip_empty: bool = True) -> list[tuple[str, str]]:
    """(text, metadata) of each row of each table."""
    out = []
    for table in read_tables(text, skip_empty):
        if references:
            resolve(table)
        by_key = style == "primary_key_based" and names_rows(table.headers[0])
        for i, row in enumerate(table.named):
            meta = {"table_title": table.context, "table_index": table.index, "row_index": i, "raw_data": row, "numeric_fields": numbers(row)}
            out.append((row_text(table, row, by_key), json.dumps(meta, ensure_ascii=False)))
    return out


def exploded(df: DataFrame, text_col: str, chunks_of) -> DataFrame:
    """One row for each chunk that chunks_of gives for a text; places are always 0."""

    @F.pandas_udf("array<struct<text: string, metadata: string>>")
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(t) if t else [] for t in texts], dtype=object)

    kept = [c for c in df.columns if c != text_col]
    rows = df.select(*kept, F.posexplode(chunks(F.col(text_col))).alias("chunk_index", "c"))
    return rows.select(*kept, "chunk_index", "c.text", "c.metadata", F.lit(0).alias("char_start"), F.lit(0).alias("char_end"))


def _told_tables(text: str, references: bool, skip_empty: bool) -> list[tuple]:
    """Tables as table_rows.TABLES has them: `first` is the number of rows in the tables before."""
    out, first = [], 0
    for table in read_tables(text, skip_empty):
        if references:
            resolve(table)
        out.append((table.index, table.context, table.headers, first, [[n[h] for h in table.headers] for n in table.named]))
        first += len(table.named)
    return out


def html_table(df: DataFrame, params: dict | None = None, text_col: str = "text", native: bool = True) -> DataFrame:
    """A chunk for each row of each table. native: what rows say is told by column expressions, row by row, and Python only reads the tables."""
    p = {"enable_reference_resolution": True, "template_style": "default", "skip_empty_rows": True} | (params or {})
    references, style, skip = bool(p["enable_reference_resolution"]), p["template_style"], bool(p["skip_empty_rows"])
    if not native:
        return exploded(df, text_col, lambda t: table_chunks(t, references, style, skip))

    kind = to_arrow_type(T._parse_datatype_string(table_rows.TABLES))

    @F.arrow_udf(table_rows.TABLES)
    def tables(texts: pa.Array) -> pa.Array:
        # One document after the other, so that only one is held as Python objects.
        found = (pa.array([_told_tables(t.as_py() or "", references, skip)], kind) for t in texts)
        return pa.concat_arrays([pa.array([], kind), *found])

    kept = [f"`{c}`" for c in df.columns if c != text_col]
    own = "_t"
    while any(c.lower().startswith(own) for c in df.columns):
        own = f"_{own}"
    parsed = df.select(*kept, tables(F.col(f"`{text_col}`")).alias(own))
    # What rows share goes beside them as columns of its own: in one value with the rows, all of them would be copied to each.
    shared = [f"{own}_{c}" for c in ("index", "context", "headers", "first")]
    index, context, headers, first = shared
    listed, row, values, keyed, columns = (f"{own}_{c}" for c in ("rows", "row", "values", "keyed", "columns"))
    each = parsed.select(*kept, F.inline(own).alias(*shared, listed))
    by_key = table_rows.names_rows(f"get({headers}, 0)", KEY_WORDS) if style == "primary_key_based" else "false"
    each = each.select(*kept, *shared, listed, F.expr(by_key).alias(keyed), F.expr(table_rows.columns(headers)).alias(columns))
    rows = each.select(*kept, *shared, keyed, columns, F.posexplode(listed).alias(row, values))
    text, metadata = table_rows.sentence(context, headers, values, keyed), table_rows.metadata(context, index, columns, values, row)
    return rows.select(*kept, (F.col(first) + F.col(row)).alias("chunk_index"), F.expr(text).alias("text"), F.expr(metadata).alias("metadata"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"))


def table_overview(df: DataFrame, params: dict | None = None, text_col: str = "text") -> DataFrame:
    """(table_index, global_context, headers, row_count) of each table, beside the other columns."""
    skip = bool((params or {}).get("skip_empty_rows", True))

    @F.pandas_udf("array<struct<table_index: int, global_context: string, headers: array<string>, row_count: int>>")
    def tables(texts: pd.Series) -> pd.Series:
        return pd.Series([[(t.index, t.context, t.headers, len(t.named)) for t in read_tables(text or "", skip)] for text in texts], dtype=object)

    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.explode(tables(F.col(text_col))).alias("t")).select(*kept, "t.*")
