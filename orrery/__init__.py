"""Spark-native trajectory, similarity and status analytics.

Every public function takes DataFrames (or a session and a path) and returns a
DataFrame; parameters are validated on the driver with ``ValueError``.
"""

__version__ = "0.1.0"
