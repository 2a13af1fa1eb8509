"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries only when it is present.
"""
