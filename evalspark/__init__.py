"""Spark-native analysis of code-generation evaluations.

Everything is a DataFrame transformation or a ``Column -> Column`` function.
Model answers and tool results come in as tables.
"""

__version__ = "0.1.0"
