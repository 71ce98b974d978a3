"""Where matrices come from and go to: generators, parquet, text."""
