"""PDF layout elements by whichever parser is installed; each falls back to the next."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = "array<struct<text: string, type: string, page_number: int, parser: string, page_range: string>>"
#: Pages that a file counts as having if they can't be counted.
UNKNOWN_PAGES = 9999
#: Kinds of elements that layout cleaning leaves out.
DROPPED = ("Header", "Footer", "PageNumber", "Image")


def _has(name: str) -> bool:
    return importlib.util.find_spec(name) is not None


def page_count(path: str) -> int:
    try:
        from pypdf import PdfReader

        return len(PdfReader(path).pages)
    except Exception:
        return UNKNOWN_PAGES


def by_pdfplumber(path: str) -> list[dict]:
    """An element for each page that has text."""
    import pdfplumber

    with pdfplumber.open(path) as pdf:
        pages = [(i, page.extract_text() or "") for i, page in enumerate(pdf.pages, 1)]
    return [{"text": text, "type": "text", "page_number": i, "parser": "pdfplumber"} for i, text in pages if text.strip()]


def by_unstructured(path: str, languages: tuple[str, ...] = ("zh", "en")) -> list[dict]:
    """An element for each one found; tables are those whose class is named so."""
    from unstructured.partition.auto import partition

    out = []
    for element in partition(filename=path, languages=list(languages)):
        kind = "table" if "table" in type(element).__name__.lower() else "text"
        out.append({"text": str(element), "type": kind, "page_number": getattr(element.metadata, "page_number", None), "category": getattr(element, "category", None)})
    return out


def by_docling(path: str, batch: int = 5) -> list[dict]:
    """An element for each batch of pages that can be read."""
    from docling.document_converter import DocumentConverter

    converter, out, pages = DocumentConverter(), [], page_count(path)
    for first in range(1, pages + 1, batch):
        last = min(first + batch - 1, pages)
        try:
            text = converter.convert(path, page_range=(first, last)).document.export_to_markdown()
        except Exception:
            if pages == UNKNOWN_PAGES:
                break
            continue
        if text.strip():
            out.append({"text": text, "type": "text", "parser": "docling", "page_range": f"{first}-{last}"})
    return out


def elements_of(path: str, use_docling: bool = False, languages: tuple[str, ...] = ("zh", "en"), batch: int = 5) -> list[dict]:
    """Elements by the parser asked for, else by pdfplumber; none if no parser can read the file."""
    first: Callable[[str], list[dict]] = (lambda p: by_docling(p, batch)) if use_docling else (lambda p: by_unstructured(p, languages))
    for parser in (first, by_pdfplumber):
        try:
            if found := parser(path):
                return found
        except Exception:  # a parser that is missing or fails gives way to the next
            continue
    return []


def with_elements(df: DataFrame, path_col: str = "file_path", **options) -> DataFrame:
    """df with `elements`, ready for splitting.pdf_elements. Files that are not PDF have none."""

    @F.pandas_udf(ELEMENTS)
    def elements(paths: pd.Series) -> pd.Series:
        keys = ("text", "type", "page_number", "parser", "page_range")
        return pd.Series([[{k: e.get(k) for k in keys} for e in elements_of(p, **options)] if p and p.lower().endswith(".pdf") else [] for p in paths], dtype=object)

    return df.withColumn("elements", elements(F.col(path_col)))


def without_furniture(elements: list[dict]) -> tuple[str, list[dict]]:
    """Layout cleaning: text of the elements but headers, footers, page numbers and images, and the changes."""
    kept = [e["text"] for e in elements if e.get("category") not in DROPPED]
    gone = [{"op": "layout_remove", "detail": f"移除了 {e['category']} 元素"} for e in elements if e.get("category") in DROPPED]
    return "\n\n".join(kept), [*gone, {"op": "layout_reorder", "detail": "按阅读顺序重排了版面内容"}]
