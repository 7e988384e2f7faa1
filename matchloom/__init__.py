"""Candidate-to-job matching analytics as Spark jobs.

Everything is a function over Columns (``functions``) or over DataFrames
(``operators``, ``sources``, ``streaming``); ``plans`` wires them into the
named queries of ``__spark_entry__.py``.
"""
