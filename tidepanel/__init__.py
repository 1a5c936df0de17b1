"""tidepanel: time-series panel analytics and corpus operators on Spark DataFrames."""
