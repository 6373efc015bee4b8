"""terraloc: place recognition, localisation and corpus preparation on Spark DataFrames."""
