"""Operators that prepare large text corpora for model training.

Nothing else in the package imports this one; ``__spark_entry__`` adds its queries when it is present.
"""
