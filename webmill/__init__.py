"""Web content for AI crawlers, prepared and accounted for with Spark DataFrames."""
