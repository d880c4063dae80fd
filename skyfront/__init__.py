"""skyfront: PySpark-native analytics for sets of points in objective space.

Operators take DataFrames and return DataFrames.  See README.md.
"""

__version__ = "0.1.0"
