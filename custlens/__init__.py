"""Customer analytics on Spark: profile, featurise, segment and classify shoppers."""
