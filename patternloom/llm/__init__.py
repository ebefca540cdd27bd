"""Training-data operators for very large text corpora.

Every module holds one operator with its own general interface; `queries`
holds the thin registered queries.  Nothing outside this subpackage and the
top-level `corpus_pipeline` module imports it.
"""
