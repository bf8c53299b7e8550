"""Training-data operators: language identification, deduplication, decontamination, packing, filtering, search, archives.

Nothing outside this subpackage imports it.  ``quillgraph.llm.entry`` holds the registered queries and their SQL.
"""
