"""quillspan: document-text analytics on Spark DataFrames."""
