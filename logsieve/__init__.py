"""logsieve: a PySpark-native engine for cloud security logs.

Layers: ``plans`` (the rule language and its compilation to Catalyst columns), ``functions``
(reusable column expressions), ``sources`` (file discovery, identification and normalization),
``operators`` (case store and result queries) and ``streaming`` (rules over Structured Streaming).
"""

__version__ = "0.1.0"
