"""Message-campaign analytics as plain Spark DataFrames."""
