"""Training-data operators (deduplication, classifiers, search, tokenizers, mixing).

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
