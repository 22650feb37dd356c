"""assayer: data-quality measurement and repair for Spark tables.

Every operation takes DataFrames and returns DataFrames.
"""

ROW_ID = "_row_id"
