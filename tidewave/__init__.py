"""Timeline analytics on Spark: intervals, segments, signals and spectra as DataFrames."""
