"""peptrail: target/decoy confidence estimation and record re-scoring on Spark DataFrames.

Importing the package starts no Spark session and reads no data.
"""

__version__ = "0.1.0"
