"""glotmill: document-localization analytics and corpus operators on Spark DataFrames."""
