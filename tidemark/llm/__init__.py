"""Training-data operators: classifiers, scanners, deduplication, tokenization, packing, extraction.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to a
DataFrame with its own general interface; the thin ``opN_*`` queries over the corpus tables live in
``queries.py``.
"""
