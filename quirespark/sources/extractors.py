"""Extractor plug-ins: one page in, one reading out, as a Python data source and as a batch function."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("text", "markdown", "json", "csv", "markdown_table")
READING = "page_id string, content string, format string, confidence double, warnings array<string>, error string"


@dataclass
class Reading:
    content: str
    format: str = "text"
    confidence: float | None = None
    warnings: list[str] = field(default_factory=list)


class Extractor(Protocol):
    name: str
    version: str

    def extract(self, page_id: str, content: str) -> Reading: ...


_REGISTRY: dict[str, Callable[..., Extractor]] = {}


def register(name: str, make: Callable[..., Extractor]) -> None:
    _REGISTRY[name] = make


def load(name: str, options: dict[str, Any] | None = None) -> Extractor:
    """A registered extractor, or ``module:object``."""
    if name in _REGISTRY:
        e = _REGISTRY[name](**(options or {}))
    elif ":" in name:
        module, _, attr = name.partition(":")
        e = getattr(importlib.import_module(module), attr)(**(options or {}))
    else:
        raise KeyError(name)
    if issues := conformance(e):
        raise TypeError(f"{name}: {', '.join(issues)}")
    return e


def conformance(e: object) -> list[str]:
    """What an extractor lacks of the protocol."""
    out = [f"{k} is no string" for k in ("name", "version") if not isinstance(getattr(e, k, None), str)]
    return out + ([] if callable(getattr(e, "extract", None)) else ["extract can't be called"])


def problems(r: object) -> str | None:
    """What is wrong with a reading."""
    if not isinstance(r, Reading) or not isinstance(r.content, str):
        return "no_reading"
    if r.format not in FORMATS:
        return "unknown_format"
    if r.confidence is not None and not 0 <= r.confidence <= 1:
        return "confidence_out_of_range"
    return None


def extract(pages: DataFrame, name: str, options: dict[str, Any] | None = None) -> DataFrame:
    """Readings of ``pages`` (page_id, content); a page whose extraction fails has its error and no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = load(name, options)
        for b in batches:
            rows = []
            for pid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    r = e.extract(pid, text or "")
                    fault = problems(r)
                except Exception as x:  # an extractor's fault is the page's, not the job's
                    r, fault = None, type(x).__name__
                rows.append((pid, None, None, None, None, fault) if fault else (pid, r.content, r.format, r.confidence, r.warnings, None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "content", "format", "confidence", "warnings", "error"])

    return pages.select("page_id", "content").mapInArrow(run, READING)


class _Plain:
    """The built-in extractor: the page's own text."""

    name, version = "text", "1"

    def extract(self, page_id: str, content: str) -> Reading:
        return Reading(content)


register("text", _Plain)


def with_retry(failed: DataFrame, name: str, options: dict[str, Any] | None = None) -> DataFrame:
    """A second pass over pages whose first failed for a transient reason."""
    again = failed.filter(F.col("error").isin("TimeoutError", "ConnectionError"))
    return extract(again, name, options)
