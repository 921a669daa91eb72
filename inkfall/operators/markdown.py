"""Chunks of Markdown by its headers, split in one Arrow batch at a time or by column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfall.operators.headings import markdown_sections
from inkfall.operators.splitting import locate

HEADERS = (("#", "Header 1"), ("##", "Header 2"), ("###", "Header 3"), ("####", "Header 4"))


def _header(line: str, headers: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The longest mark that the line begins with as a word, and its name."""
    fits = [h for h in headers if line == h[0] or line.startswith(f"{h[0]} ")]
    return max(fits, key=lambda h: len(h[0]), default=None)


def _paragraphs(text: str, headers: list[tuple[str, str]], bare: bool) -> Iterator[tuple[list[str], dict[str, str]]]:
    """Runs of lines without a blank one or a header between them, each with its open headers."""
    fence, lines, path = "", [], []

    def metadata() -> dict[str, str]:
        return {name: title for _, name, title in path}

    for raw in text.split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            fence = "" if line.startswith(fence) else fence
        elif line.startswith("~~~") or line.startswith("```") and line.count("```") == 1:
            fence = line[:3]
        header = None if fence else _header(line, headers)
        if header or not line and not fence:
            if lines:
                yield lines, metadata()
            lines = []
        if header:
            mark, name = header
            path = [*(h for h in path if h[0] < mark.count("#")), (mark.count("#"), name, line[len(mark) :].strip())]
        if line and not (header and bare) or fence:
            lines.append(line)
    if lines:
        yield lines, metadata()


def sections(text: str, headers: list[tuple[str, str]], bare: bool) -> list[tuple[str, dict[str, str]]]:
    """Paragraphs under one header path together; a header alone goes with the deeper one after it."""
    out: list[tuple[str, dict[str, str]]] = []
    for lines, path in _paragraphs(text, headers, bare):
        part = "\n".join(lines)
        if out:
            before, open_ = out[-1]
            lone = not bare and len(open_) < len(path) and before.rpartition("\n")[2].startswith("#")
            if open_ == path or lone:
                out[-1] = (f"{before}  \n{part}", path)
                continue
        out.append((part, path))
    return out


def markdown_chunks(text: str, headers: list[tuple[str, str]], bare: bool) -> list[tuple[str, int, int, str]]:
    out, at = [], 0
    for part, path in sections(text, headers, bare):
        start, at = locate(text, part, at)
        out.append((part, start, at, json.dumps({"strip_headers": bare, **path}, ensure_ascii=False, separators=(",", ":"))))
    return out


def markdown_structure(df: DataFrame, params: dict | None = None, text_col: str = "text", native: bool = True) -> DataFrame:
    """Chunks of one header path each; metadata holds strip_headers and the open headers.

    native is without Python, and is not taken where two marks have one name. It keeps code points
    that are not assigned, which the other form leaves out of a line.
    """
    p = {"strip_headers": False, "headers": HEADERS} | (params or {})
    headers, bare = [tuple(h) for h in p["headers"]], bool(p["strip_headers"])

    @F.pandas_udf("array<struct<text: string, char_start: int, char_end: int, metadata: string>>")
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([markdown_chunks(t or "", headers, bare) for t in texts], dtype=object)

    kept = [f"`{c}`" for c in df.columns if c != text_col]
    found = markdown_sections(text_col, headers, bare) if native and len({name for _, name in headers}) == len(headers) else chunks(F.col(text_col))
    return df.select(*kept, F.posexplode(found).alias("chunk_index", "c")).select(*kept, "chunk_index", "c.text", "c.metadata", "c.char_start", "c.char_end")
