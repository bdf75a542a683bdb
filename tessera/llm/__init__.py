"""Training-data operators (document sketches, scoring, mixing, dedup, search, packing).

Nothing outside this subpackage, ``corpus_pipeline.py`` and the guarded block of
``__spark_entry__.py`` imports it."""
