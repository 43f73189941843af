"""Operators for large training-text pipelines (near-duplicates,
decontamination, tokenisation, line rules, classifiers, filters).

Nothing else in the library imports this subpackage.
"""
