"""Spark-native corpus grounding, auditing and evaluation engine.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column expressions and Arrow kernels),
``operators`` (DataFrame -> DataFrame operators), ``plans`` (the registered queries with their SQL),
``streaming`` (incremental variants) and the optional ``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
