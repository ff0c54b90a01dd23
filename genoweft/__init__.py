"""genoweft: recurrent gene programs and tabular analytics on Spark DataFrames."""
