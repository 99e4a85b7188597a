"""Operators of a training-data pipeline: URL filters, packing, language
identification, token counts, PII, quality rules, similarity join, benchmark
decontamination, repeated passages and token files.

Nothing outside this folder imports it. ``queries.py`` registers one thin query
per operator in ``QUERIES`` and, where SQL can express it, its DuckDB text in
``ORACLE``.
"""
