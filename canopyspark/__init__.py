"""Plot-level analytics of multispectral field imagery, expressed as Spark DataFrames."""
