"""Operators of a training-data pipeline: mixing, rules, search, packing,
language and quality models, URL filters, licence scans, archives, near copies,
lexical search, token alignment and token counts.

Nothing else in the library imports this subpackage.
"""
