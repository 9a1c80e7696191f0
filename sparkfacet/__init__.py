"""sparkfacet: catalogue search, trust scoring, fitment and order analytics as Spark DataFrame transformations."""
