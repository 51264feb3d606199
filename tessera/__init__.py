"""Arrays, images, signals and acquisition streams on Spark DataFrames."""
