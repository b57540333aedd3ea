"""quern: document retrieval and document analytics on Spark DataFrames."""
