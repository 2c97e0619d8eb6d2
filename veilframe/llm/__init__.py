"""Operators for preparing language-model training corpora on Spark.

Nothing outside this package imports it; ``corpus_pipeline.py`` and
``__spark_entry__.py`` are its only users.
"""
