"""Market analytics on Spark: ordered window analytics over one long table of bars."""
