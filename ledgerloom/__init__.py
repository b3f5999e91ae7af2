"""Budget reconciliation and change sets on Spark DataFrames."""
