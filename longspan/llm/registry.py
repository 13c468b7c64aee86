"""The modules that hold queries."""

from __future__ import annotations

import importlib

NAMES = ["decontaminate", "html_text", "jaccard_join", "licenses", "line_dedup", "packing", "phrases", "spelling", "suffix_tree", "token_counts", "topk", "toxicity", "warc"]


def modules() -> list:
    return [importlib.import_module(f"longspan.llm.{n}") for n in NAMES]
