"""martline: sales ingestion, quality, mart and analytics operators on PySpark DataFrames."""
