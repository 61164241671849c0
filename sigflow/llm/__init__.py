"""Operators for building training corpora: decontamination, mixing, search, deduplication, archives, classifiers.

Nothing else in the library imports this subpackage.
"""
