"""Spindrift: search analytics on Spark, from page records to ranked results.

Everything is a DataFrame plan; see README.md for the map of the package.
"""

__version__ = "0.1.0"
