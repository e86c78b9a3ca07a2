"""Structured-similarity analytics on DataFrames.

Rows, nested documents, word sequences and graphs become ternary vectors
(``BINARY`` columns, one signed byte per dimension); searches, groupings and
scores over those vectors are ordinary Spark jobs.
"""

__version__ = "0.1.0"
