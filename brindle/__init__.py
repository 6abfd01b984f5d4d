"""brindle: a small analytics engine whose plans are Spark DataFrames."""

from brindle.functions import avg, binary, col, count, lit, max_, min_, sort, sum_
from brindle.operators.frame import Frame
from brindle.session import SessionContext
from brindle.sources import CsvReadOptions

__all__ = ["CsvReadOptions", "Frame", "SessionContext", "avg", "binary", "col", "count", "lit", "max_", "min_", "sort", "sum_"]
