"""Cost analytics over cloud-warehouse metadata, as Spark DataFrame jobs.

Every analysis in :mod:`slotledger.plans` is a function from DataFrames and a
parameter dataclass to a DataFrame.  Nothing is collected and nothing runs until
the caller triggers an action.
"""

__version__ = "0.1.0"
