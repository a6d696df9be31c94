"""lacuna: literature-based discovery on Spark DataFrames.

Every operator takes and returns DataFrames; topics, pairs and parameters are columns or literals, so that one plan
serves one topic or ten thousand.
"""

__version__ = "0.1.0"
