"""Training-data operators for very large text corpora.

Each module holds one operator with its own general interface; ``llm.queries`` holds the thin
registered queries.  Nothing outside this subpackage imports it.
"""
