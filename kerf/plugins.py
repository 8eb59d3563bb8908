"""Parsers and formatters that callers register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kerf.kernels import engine

_FORMATTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_parser(language: str, parser: Callable) -> None:
    """``parser(path, text)`` gives (entities, imports, spans of top-level statements), or None to leave it to the engine."""
    if language in engine.PARSERS:
        raise ValueError(f"there is a parser for {language}")
    engine.PARSERS[language] = parser


def clear_parsers() -> None:
    engine.PARSERS.clear()


def register_formatter(name: str, formatter: Callable[[DataFrame], DataFrame]) -> None:
    if name in _FORMATTERS:
        raise ValueError(f"there is a formatter {name}")
    _FORMATTERS[name] = formatter


def formatters() -> list[str]:
    return sorted(_FORMATTERS)


def format_chunks(name: str, chunks: DataFrame) -> DataFrame:
    return _FORMATTERS[name](chunks)


def clear_formatters() -> None:
    _FORMATTERS.clear()
