"""tallygrid: DataFrame-to-DataFrame operators for benchmark data, scoring and export on Spark."""
