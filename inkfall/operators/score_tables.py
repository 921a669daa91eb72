"""HTML score tables with merged cells: dimensions to the left, a pair of columns for each person.

A table's cells are laid out on a grid, the columns of each person found by one of four signs, and
every score told by a template, alone or with all of the person's scores of one weight.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate, zip_longest

from pyspark.sql import DataFrame

from inkfall.operators.html import Element, cell_text, parse
from inkfall.operators.row_tables import exploded, looks_like_header

# Marks of scores, of reasons, of names and of cells without data.
SCORE_WORDS = ("评分", "得分", "分数")
SCORE_LABELS = ("评分", "评分理由", "得分", "分数", "nan", "")
NO_SCORE = ("nan", "", "/", "-", "—", "#N/A", "#REF!", "N/A", "无", "空")
NO_REASON = ("nan", "", "/", "-", "—", "#N/A")
FLAT_HEADERS = (
    r"[一-龥]{2,4}[-—]?(?:评价|评分|得分|分数|理由|自评|他评|上级评)",
    r"[一-龥]{2,4}\s*(?:评分|得分|分数)",
)
NAME_PREFIX = r"^姓名[：:]?\s*"


def _person(cell: str) -> str:
    return re.sub(NAME_PREFIX, "", cell).strip()


def grid(table: Element) -> tuple[list[list[str]], list[list[str]]]:
    """Header rows, all of whose cells are th, and data rows, with spans laid out.

    A cell that spans rows keeps its text below in data and leaves a blank in headers. Spans are
    looked for before each cell, so those past a row's last cell are lost; a th in a data row is
    passed over. Data rows are at least as wide as the headers.
    """
    parts: dict[bool, list[list[str]]] = {True: [], False: []}
    below: dict[bool, dict[tuple[int, int], str]] = {True: {}, False: {}}
    for row in table.walk("tr"):
        cells = list(row.walk("td", "th"))
        if not cells:
            continue
        head = all(c.name == "th" for c in cells)
        line: list[str] = []
        at = len(parts[head])
        for cell in cells:
            while (at, len(line)) in below[head]:
                line.append(below[head].pop((at, len(line))))
            if cell.name == "th" and not head:
                continue
            text, across, down = cell_text(cell), cell.span("colspan"), cell.span("rowspan")
            for column in range(len(line), len(line) + across):
                for r in range(1, down):
                    below[head][at + r, column] = "" if head else text
            line += [text] * across
        parts[head].append(line)
    width = max(map(len, parts[True]), default=10)
    wide = [line + [""] * (width - len(line)) for line in parts[True]]
    rows = [line + [""] * (width - len(line)) for line in parts[False]]
    widest = max(map(len, rows), default=0)
    return wide, [line + ["None"] * (widest - len(line)) for line in rows]


def _names_in_first_row(first: list[str]) -> list[str]:
    """People named in a first row of labels: every second cell from the sign on."""
    start = None
    for i, cell in enumerate(first):
        if cell in SCORE_WORDS and i + 1 < len(first):
            start = max(i - 1, 0)
        elif cell == "序号":
            start = i + 1
        if start is not None:
            break
    cells = first[start::2] if start is not None else []
    return [name for cell in cells if cell not in SCORE_LABELS and (name := _person(cell))]


@dataclass(frozen=True)
class _Column:
    """A column of the header: its place, its upper and its lower cell."""

    at: int
    top: str
    below: str

    def scores(self) -> bool:
        return self.top not in ("", "nan") and any(w in self.below for w in SCORE_WORDS)

    def reasons(self) -> bool:
        return any(w in self.below for w in ("理由", "说明"))

    def names(self) -> bool:
        return "姓名" in self.top and bool(_person(self.top))


def _chosen(columns: list[_Column], sign: Callable[[_Column], bool], yields: Callable[[_Column], bool]) -> list[_Column]:
    """Columns with a sign, but for those that yield to a chosen one right before them."""
    flags = accumulate(columns, lambda before, c: sign(c) and not (before and yields(c)), initial=False)
    return [c for c, chosen in zip(columns, list(flags)[1:], strict=True) if chosen]


def _next_if(columns: list[_Column], column: _Column, test: Callable[[_Column], bool]) -> int:
    """The place of the column after this one if it passes the test; -1 otherwise."""
    return next((c.at for c in columns[column.at + 1 : column.at + 2] if test(c)), -1)


def _by_lower_cells(columns: list[_Column], named: list[str]) -> list[tuple[str, int, int]]:
    """Names above, scores and reasons below."""
    return [(_person(c.top), c.at, _next_if(columns, c, _Column.reasons)) for c in _chosen(columns, _Column.scores, _Column.reasons)]


def _by_name_headers(columns: list[_Column], named: list[str]) -> list[tuple[str, int, int]]:
    """Headers that say they are a name; the column after one belongs to it."""
    told = lambda c: "理由" in c.top or "理由" in c.below
    return [(_person(c.top), c.at, _next_if(columns, c, told)) for c in _chosen(columns, _Column.names, lambda c: True)]


def _by_flat_headers(columns: list[_Column], named: list[str]) -> list[tuple[str, int, int]]:
    """A name and a mark in one header."""
    return [(c.top, c.at, -1) for c in columns for form in FLAT_HEADERS if re.match(form, c.top)]


def _by_first_row(columns: list[_Column], named: list[str]) -> list[tuple[str, int, int]]:
    """Names in the first data row, for the score columns, or every second column from the first of these."""
    scores = [c.at for c in columns if "评分" in c.top or "得分" in c.top]
    places = scores if len(scores) == len(named) else range(scores[0] if scores else len(columns), len(columns), 2)
    return [(name, at, _next_if(columns, columns[at], lambda c: True)) for name, at in zip(named, places, strict=False)]


def people(headers: list[list[str]], named: list[str]) -> list[tuple[str, int, int]]:
    """(name, column of the score, column of the reason or -1), by the first sign that finds any."""
    top, below = ([cell.strip() for cell in row] for row in (*headers[:2], [])[:2])
    columns = [_Column(i, cell, under) for i, (cell, under) in enumerate(zip_longest(top, below[: len(top)], fillvalue=""))]
    found = (sign(columns, named) for sign in (_by_lower_cells, _by_name_headers, _by_flat_headers, _by_first_row))
    return next(filter(None, found), [])


def long_rows(headers: list[list[str]], rows: list[list[str]]) -> list[dict[str, str]]:
    """A record for each row and person with a score: dim_0 and on, employee, score, reason."""
    named: list[str] = []
    if looks_like_header(rows[0][:3]):
        named = _names_in_first_row([c.strip() for c in rows[0]])
        rows = rows[1:]
    if rows and len(rows[0]) - len(headers[0]) > 1:
        raise IndexError("the data are wider than the headers")
    headers = [line + [""] * (len(rows[0]) - len(line)) if rows else line for line in headers]
    found = people(headers, named)
    out = []
    for row in rows:
        for name, score, reason in found:
            if row[score].strip() in NO_SCORE:
                continue
            told = row[reason] if 0 <= reason < len(row) else ""
            dims = {f"dim_{k}": row[k] if row[k] != "nan" else "" for k in range(min(i for _, i, _ in found))}
            out.append({**dims, "employee": name, "score": row[score], "reason": "" if told.strip() in NO_REASON else told})
    return out


def _cut(value: str, most: int) -> str:
    return f"{value[:most]}…" if 0 < most < len(value) and value != "nan" else value


def _topic(row: dict[str, str], most: int) -> str:
    return "-".join(x for x in (row.get("dim_1", ""), _cut(row.get("dim_2", ""), most)) if x and x != "nan")


def _background(items: list[str]) -> str:
    return f"\n（背景信息：{'；'.join(items)}）" if items else ""


def score_text(row: dict[str, str], most: int) -> str:
    """One score as a sentence; empty without a person."""
    if not row["employee"].strip() or row["score"] in ("nan", ""):
        return ""
    group, weight, norm = row.get("dim_0", ""), row.get("dim_3", ""), _cut(row.get("dim_4", ""), most)
    topic, reason = _topic(row, most), row["reason"]
    parts = [f"在【{group}】的绩效考核中"] * (group not in ("", "nan"))
    parts.append(f"员工【{row['employee']}】")
    parts += [f"在【{topic}】上"] * bool(topic)
    parts.append(f"得分为【{row['score']}】分")
    parts += [f"评分理由：【{reason}】"] * (reason not in ("", "nan"))
    items = [f"指标权重：{weight}"] * (weight not in ("", "nan")) + [f"考核标准：{norm}"] * (norm not in ("", "nan"))
    return "，".join(parts) + "。" + _background(items)


def weight_text(rows: list[dict[str, str]], weight: str, most: int) -> str:
    """All scores of one person and weight as a list."""
    lines = []
    for row in rows:
        if row["score"] in ("nan", ""):
            continue
        topic, reason = _topic(row, most), row["reason"]
        score = f"得分为【{row['score']}】分" + (f"（评分理由：{reason}）" if reason not in ("", "nan") else "")
        lines.append(f"- {topic}：{score}。" if topic else f"- {score}。")
    if not lines:
        return ""
    group = next((g for row in rows if (g := row.get("dim_0", "")) not in ("", "nan")), "")
    head = [f"在【{group}】的绩效考核中"] * bool(group) + [f"员工【{rows[0]['employee']}】"]
    head.append(f"在权重【{weight}】的考核指标上表现如下" if weight else "的考核指标上表现如下")
    norms = dict.fromkeys(_cut(n, most) for row in rows if (n := row.get("dim_4", "")) not in ("", "nan"))
    items = [f"指标权重：{weight}"] * bool(weight) + [f"考核标准：{n}" for n in norms]
    return "，".join(head) + "：\n" + "\n".join(lines) + _background(items)


def _score_metadata(row: dict[str, str]) -> dict:
    meta: dict = {k: row[k] for k in (f"dim_{i}" for i in range(5)) if k in row and row[k] != "nan"}
    score = row["score"].replace("分", "").strip()
    try:
        value: float | str = float(score)
    except ValueError:
        value = score
    return {**meta, "employee_name": row["employee"], "score": value, "raw_row": row}


def score_chunks(text: str, style: str = "indicator_split", most: int = 150) -> list[tuple[str, str]]:
    """(text, metadata) of each score, or of each person and weight in the order of first appearance."""
    out: list[tuple[str, dict]] = []
    for table in parse(text).walk("table"):
        headers, rows = grid(table)
        records = long_rows(headers, rows) if headers and rows else []
        if style == "weight_split":
            groups: dict[tuple[str, str], list[dict[str, str]]] = {}
            for row in records:
                groups.setdefault((row["employee"], row.get("dim_3", "")), []).append(row)
            for (name, weight), some in groups.items():
                shown = weight if weight.strip() not in ("", "nan") else ""
                out.append((weight_text(some, shown, most), {"employee_name": name, "weight": shown, "indicator_count": len(some), "raw_rows": some}))
        else:
            out += [(score_text(row, most), _score_metadata(row)) for row in records]
    return [(told, json.dumps(meta, ensure_ascii=False)) for told, meta in out if told]


def complex_table(df: DataFrame, params: dict | None = None, text_col: str = "text") -> DataFrame:
    """Chunks of score tables. A document with a table that can't be laid out gives none; `strict` raises."""
    p = {"template_style": "indicator_split", "max_field_length": 150, "strict": False} | (params or {})
    style, most, strict = p["template_style"], int(p["max_field_length"]), bool(p["strict"])

    def chunks_of(text: str) -> list[tuple[str, str]]:
        try:
            return score_chunks(text, style, most)
        except (IndexError, ValueError):
            if strict:
                raise
            return []

    return exploded(df, text_col, chunks_of)
