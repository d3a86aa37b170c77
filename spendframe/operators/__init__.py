"""DataFrame-to-DataFrame operators.

Ledger operators take ``keys``, the columns that identify a ledger; ``keys=[]``
treats the whole table as one ledger.
"""
