"""colloquy: conversational-corpus analytics as Spark DataFrame operators.

Subpackages: ``sources`` (readers/sinks), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame steps), ``plans`` (skew-safe ranking and
windowing helpers, the registered query suite), ``streaming`` (intentionally
empty: the reference has no streaming surface).
"""

__version__ = "0.1.0"
