"""vantidal: a PySpark-native engine for point-in-time time-series analytics.

Every operator is a function from DataFrame to DataFrame that declares a plan;
Catalyst and adaptive execution choose how it runs.
"""

__version__ = "0.1.0"
