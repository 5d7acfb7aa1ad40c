"""One entry for all query texts."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame

from . import algebra_script, cypher, datalog, scheme
from .catalog import GraphCatalog
from .traversal import Traversal, traverse

LANGUAGES = ("cypher", "datalog", "script", "scheme")


def detect_language(text: str) -> str:
    body = re.sub(r"(?m)^\s*(//|%|#|;).*$", "", text).strip()
    if re.match(r"(?i)match\b", body):
        return "cypher"
    if body.startswith("("):
        return "scheme"
    if ":-" in body or body.startswith("?-") or re.fullmatch(r"(?s)(\s*[a-z_]\w*\([^()]*\)\s*\.)+\s*", body):
        return "datalog"
    return "script"


class Statement:
    """A text with parameters bound one at a time."""

    def __init__(self, engine: Engine, text: str, lang: str | None = None):
        self.engine, self.text, self.lang, self.params = engine, text, lang or detect_language(text), {}

    def bind(self, name: str, value: Any) -> Statement:
        self.params[name] = value
        return self

    def execute(self, **options: Any) -> DataFrame:
        return self.engine.query(self.text, self.lang, self.params, **options)


class Engine:
    def __init__(self, catalog: GraphCatalog):
        self.catalog = catalog

    def prepare(self, text: str, lang: str | None = None) -> Statement:
        return Statement(self, text, lang)

    def query(self, text: str, lang: str | None = None, params: dict[str, Any] | None = None, **options: Any) -> DataFrame:
        """The answer of a query in any of the languages, as a DataFrame."""
        lang = lang or detect_language(text)
        runs = {"cypher": cypher.run, "datalog": datalog.run, "script": algebra_script.run, "scheme": scheme.run}
        if lang not in runs:
            raise ValueError(f"unknown language {lang}")
        return runs[lang](text, self.catalog, params, **options)

    def set_parallelism(self, partitions: int) -> Engine:
        """Partitions of the shuffles that follow."""
        self.catalog.spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        return self

    def traverse(self) -> Traversal:
        return traverse(self.catalog)
