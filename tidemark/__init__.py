"""Tidemark: a Spark-native engine for versioned documents, agent traces and graded runs.

Everything is a function from DataFrame(s) to DataFrame.  The optional subpackage
``llm`` holds the training-data operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
