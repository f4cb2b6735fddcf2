"""A Spark-native engine for labour-market and evidence analytics.

Operators are functions from DataFrames to DataFrames or from columns to
columns. ``tessera.plans`` binds them to tables as registered queries.
"""

__version__ = "0.1.0"
