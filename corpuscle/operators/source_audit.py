"""Static rules over Python sources: a catalogue of rules, each a test of a syntax node."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, category, severity, what it forbids, kind of test, pattern).
RULES = [
    ("graph-library", "scope", "error", "graph analysis", "import", r"^(networkx|igraph|graph_tool)(\.|$)"),
    ("vector-library", "scope", "error", "embeddings and vector search", "import", r"^(faiss|sentence_transformers|gensim|annoy|hnswlib)(\.|$)"),
    ("fuzzy-match", "scope", "error", "fuzzy identity", "import", r"^(rapidfuzz|fuzzywuzzy|Levenshtein|jellyfish|difflib)(\.|$)"),
    ("citation-name", "scope", "warning", "citation analysis", "name", r"citation_(graph|network)|co_?citation|page_?rank"),
    ("embedding-name", "scope", "warning", "embeddings", "name", r"(^|_)(embedding|embed)s?(_|$)"),
    ("dynamic-code", "safety", "error", "code from text", "call", r"^(eval|exec)$"),
]
SUPPRESS = re.compile(r"#\s*scope:\s*allow(?:\s+([\w, -]+))?")
VIOLATION = "path string, line int, rule string, category string, severity string, detail string"


def catalogue(spark: SparkSession) -> DataFrame:
    """The rules as a dimension."""
    return spark.createDataFrame(RULES, "rule string, category string, severity string, forbids string, kind string, pattern string")


def violations(path: str, source: str) -> Iterator[tuple]:
    """What the rules find in one file; a line's comment can allow named rules, or all."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        yield path, e.lineno or 0, "syntax", "safety", "error", str(e.msg)
        return
    lines = source.splitlines()
    for node in ast.walk(tree):
        found = []
        if isinstance(node, ast.Import):
            found = [("import", a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found = [("import", node.module or "")]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            found = [("call", node.func.id)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found = [("name", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", node.name).lower())]
        for kind, value in found:
            for rule, category, severity, _, test, pattern in RULES:
                if test == kind and re.search(pattern, value):
                    allow = SUPPRESS.search(lines[node.lineno - 1])
                    if not (allow and (not allow[1] or rule in re.split(r"[,\s]+", allow[1]))):
                        yield path, node.lineno, rule, category, severity, value


def audit(files: DataFrame) -> DataFrame:
    """Violations of rows (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [v for p, t in zip(b["path"], b["text"]) for v in violations(p, t or "")]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in VIOLATION.split(", ")])

    return files.select("path", "text").mapInPandas(run, VIOLATION)


def rollup(found: DataFrame) -> DataFrame:
    """Violations by category and severity."""
    return found.groupBy("category").pivot("severity", ["error", "warning"]).agg(F.count(F.lit(1))).na.fill(0)
