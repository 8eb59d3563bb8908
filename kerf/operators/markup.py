"""Top-level sections of YAML and TOML as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.operators import sentences

_HEADS = {"yaml": r"(?m)^(?=[\w\-.]+\s*:)", "toml": r"(?m)^(?=\[\[?[^\]\n]+\]\]?[ \t]*(?:#.*)?$)"}
_NAMES = {"yaml": r"^([\w\-.]+)\s*:", "toml": r"^\[\[?([^\]\n]+)\]"}


def key_sections(docs: DataFrame, language: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with (pos, name, section) for each section; what is before the first belongs to it."""
    docs = docs.withColumn("__cut", sentences.cut(F.col(text), _HEADS[language], ""))
    lead = (F.size("__cut") > 1) & ~F.get("__cut", F.lit(0)).rlike(_NAMES[language])
    joined = F.when(lead, F.concat(F.array(F.concat(F.get("__cut", F.lit(0)), F.get("__cut", F.lit(1)))), F.slice("__cut", 3, F.greatest(F.size("__cut") - 2, F.lit(0))))).otherwise(F.col("__cut"))
    rows = sentences.rows_of(docs, joined, "pos", "section").drop("__cut")
    return rows.withColumn("name", F.regexp_extract("section", "(?m)" + _NAMES[language], 1))
