"""codeweave — structural questions about large source-code corpora on Spark.

A corpus ``(repo, path, content)`` becomes symbol tables (``operators``);
queries, searches and reports run over them as DataFrame plans (``plans``).
"""

from .operators.tables import CodeIndex, build_index, load_index, save_index

__all__ = ["CodeIndex", "build_index", "load_index", "save_index"]
