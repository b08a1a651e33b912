"""Vehicle-trajectory analytics and corpus preparation on Spark DataFrames."""
