"""Training-data operators: filtering, scoring, packing, search, de-duplication and encoding of text corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general interface; `queries`
holds the thin registered queries and `oracles` their SQL.
"""
