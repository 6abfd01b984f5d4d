"""Sources: CSV with options and sampled inference, and Parquet."""

from brindle.sources.csv import CsvReadOptions, read_csv
from brindle.sources.parquet import read_parquet, table

__all__ = ["CsvReadOptions", "read_csv", "read_parquet", "table"]
