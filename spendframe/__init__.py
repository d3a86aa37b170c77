"""spendframe: ledger analytics, file inventories and text sequences on Spark.

Everything takes DataFrames and returns DataFrames; nothing runs until an
action is called, except the few header and layout probes that say so.
"""

from spendframe.errors import MappingRequiredError

__all__ = ["MappingRequiredError"]
