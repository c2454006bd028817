"""assetlake: analytics over large file inventories, written as Spark jobs.

Every operator takes DataFrames and plain parameters and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
