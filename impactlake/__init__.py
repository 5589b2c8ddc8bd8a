"""impactlake: change-impact analytics over legacy C/C++ code bases, as Spark DataFrames."""
