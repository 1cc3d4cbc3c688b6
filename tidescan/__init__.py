"""tidescan: declarative time-series scans planned as ordinary Spark DataFrames."""
from tidescan.operators.predicates import Op, contains, ends_with, eq, gt, gteq, is_in, lt, lteq, matches, noteq, starts_with
from tidescan.operators.scan import Scan, TsRange, plan
from tidescan.sources.catalog import Catalog

__all__ = ["Catalog", "Op", "Scan", "TsRange", "contains", "ends_with", "eq", "gt", "gteq", "is_in", "lt", "lteq", "matches", "noteq", "plan", "starts_with"]
