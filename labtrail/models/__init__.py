"""Tree ensembles through pyspark.ml."""
