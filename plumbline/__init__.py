"""plumbline: corpus, change-log, graph and findings analytics on PySpark DataFrames."""
