"""Document forensics, submission analytics and corpus operators as Spark DataFrames."""
