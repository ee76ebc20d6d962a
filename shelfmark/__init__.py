"""Archive catalogues, plans and edits as Spark DataFrames."""
