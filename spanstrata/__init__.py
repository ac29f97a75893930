"""Hierarchical byte-window, interval and evaluation operators for PySpark.

Containers hold objects, objects are cut into overlapping byte windows, and
hidden passages are known only as byte intervals.  Every public operator takes
DataFrames (plus plain parameters) and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
