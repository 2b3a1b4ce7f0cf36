"""quillspark: typed text knowledge as Spark DataFrames."""
