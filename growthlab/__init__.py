"""growthlab: longitudinal tumour-volume analysis in PySpark."""
