"""The chunking strategies by name, their parameters, and the plan from documents to chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkfall.operators import markdown, row_tables, score_tables, semantic, splitting
from inkfall.operators.cleaning import CleaningConfig, cleaned_texts

Strategy = Callable[..., DataFrame]


def _slider(key: str, low: float, high: float, step: float) -> dict:
    return {"key": key, "type": "slider", "min": low, "max": high, "step": step}


_KEYS = [{"key": k, "type": "text"} for k in ("openai_api_key", "openai_base_url", "embedding_model")]
_NO_KEYS = {"openai_api_key": "", "openai_base_url": "", "embedding_model": ""}


def _select(key: str, *options: str) -> dict:
    return {"key": key, "type": "select", "options": list(options)}


# Labels, descriptions, default parameters and limits of the strategies.
CATALOGUE: dict[str, dict] = {
    "recursive_character": {
        "label": "递归字符分块", "description": "按段落/行/空格递归切分，适合通用文本",
        "default_params": {"chunk_size": 500, "chunk_overlap": 50},
        "param_schema": [_slider("chunk_size", 100, 2000, 50), _slider("chunk_overlap", 0, 500, 10)],
    },
    "semantic": {
        "label": "语义分块", "description": "基于 Embedding 相似度在语义断点切分，适合长文档",
        "default_params": {"breakpoint_threshold": 80.0, "breakpoint_type": "percentile", "buffer_size": 1, **_NO_KEYS},
        "param_schema": [_slider("breakpoint_threshold", 10, 99, 5), _select("breakpoint_type", "percentile", "standard_deviation", "interquartile"), _slider("buffer_size", 0, 3, 1), *_KEYS],
    },
    "markdown_structure": {
        "label": "Markdown 结构分块", "description": "按 Markdown 标题层级切分，保留文档结构",
        "default_params": {"strip_headers": False},
        "param_schema": [{"key": "strip_headers", "type": "switch"}],
    },
    "pdf_table_layout": {
        "label": "PDF 表格版面分块", "description": "版面分析避免表格被切断，适合含表格的 PDF",
        "default_params": {"chunk_size": 800, "chunk_overlap": 50, "use_docling": False, "languages": "zh,en", "page_batch_size": 5},
        "param_schema": [_slider("chunk_size", 200, 2000, 50), _slider("chunk_overlap", 0, 500, 10), _select("languages", "zh,en", "zh", "en", "ja,en", "ko,en", "de,en", "fr,en"), {"key": "use_docling", "type": "switch"}, _slider("page_batch_size", 1, 50, 1)],
    },
    "parent_child": {
        "label": "父子双粒度分块", "description": "大粒度父块 + 小粒度子块，适合高精度检索场景",
        "default_params": {"parent_chunk_size": 2000, "child_chunk_size": 400, "child_chunk_overlap": 50},
        "param_schema": [_slider("parent_chunk_size", 500, 4000, 100), _slider("child_chunk_size", 100, 1000, 50), _slider("child_chunk_overlap", 0, 200, 10)],
    },
    "dialogue_aware": {
        "label": "对话体语义分块", "description": "按发言人轮次预切分 + Embedding 合并，适合对话录",
        "default_params": {"similarity_threshold": 0.75, "exchange_size": 2, **_NO_KEYS},
        "param_schema": [_slider("similarity_threshold", 0.3, 0.95, 0.05), _slider("exchange_size", 1, 6, 1), *_KEYS],
    },
    "html_table": {
        "label": "HTML 表格分块", "description": "解析 HTML <table> 标签，按行转为自然语言描述，适合含表格的 Markdown/HTML",
        "default_params": {"enable_reference_resolution": True, "template_style": "default", "skip_empty_rows": True},
        "param_schema": [{"key": "enable_reference_resolution", "type": "switch"}, _select("template_style", "default", "primary_key_based"), {"key": "skip_empty_rows", "type": "switch"}],
    },
    "complex_table": {
        "label": "复杂多维表格分块", "description": "解析多层合并单元格(rowspan/colspan)的复杂HTML表格，自动识别员工维度，适合企业绩效考核表/财务报表",
        "default_params": {"template_style": "indicator_split", "max_field_length": 150},
        "param_schema": [_select("template_style", "indicator_split", "weight_split"), _slider("max_field_length", 0, 500, 10)],
    },
}


def _pdf(df: DataFrame, params: dict | None = None, text_col: str = "text") -> DataFrame:
    if "elements" in df.columns:
        return splitting.pdf_elements(df, params, "elements", text_col)
    return splitting.pdf_text(df, params, text_col)


STRATEGIES: dict[str, Strategy] = {
    "recursive_character": splitting.recursive_character,
    "semantic": semantic.semantic,
    "markdown_structure": markdown.markdown_structure,
    "pdf_table_layout": _pdf,
    "parent_child": splitting.parent_child,
    "dialogue_aware": semantic.dialogue,
    "html_table": row_tables.html_table,
    "complex_table": score_tables.complex_table,
}

#: Strategies that compare neighbours and take an embedder.
EMBEDDING = ("semantic", "dialogue_aware")


def register(name: str, strategy: Strategy, meta: dict) -> None:
    """Add a strategy of one's own: a function of (df, params, text_col=...)."""
    STRATEGIES[name], CATALOGUE[name] = strategy, meta


def list_strategies(spark: SparkSession) -> DataFrame:
    """(name, label, description, default_params, param_schema); the last two as JSON."""
    rows = [(k, m["label"], m["description"], json.dumps(m["default_params"], ensure_ascii=False), json.dumps(m["param_schema"], ensure_ascii=False)) for k, m in CATALOGUE.items()]
    return spark.createDataFrame(rows, "name string, label string, description string, default_params string, param_schema string")


def chunk(df: DataFrame, strategy: str, params: dict | None = None, *, embed: semantic.Embedder | None = None, cleaning: CleaningConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, text, metadata, char_start, char_end) of every document, cleaned first if asked."""
    if strategy not in STRATEGIES:
        raise ValueError(f"未知的分块策略: {strategy}，可选: {list(STRATEGIES)}")
    kept = [c for c in (id_col, "elements") if c in df.columns]
    docs = cleaned_texts(df.select(*kept, text_col), cleaning, text_col)
    run = STRATEGIES[strategy]
    if strategy in EMBEDDING:
        return run(docs, params, embed, id_col, text_col)
    return run(docs, params, text_col=text_col)
