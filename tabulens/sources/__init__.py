"""Reading files of several formats into one normalised Parquet table."""
