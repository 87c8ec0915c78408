"""Operators for building language-model training corpora.

Every operator takes and returns DataFrames; nothing outside this subpackage
imports it.  ``queries`` binds the operators to the driver tables.
"""
