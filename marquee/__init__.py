"""marquee: recommender-data analytics as Spark DataFrame operators."""
