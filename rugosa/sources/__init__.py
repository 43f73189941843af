from rugosa.sources.experiments import (
    clean_numeric,
    lenient_double,
    load_experiments_csv,
    normalize_columns,
    select_required,
)
from rugosa.sources.tables import load_table, runs_from_lineitem
from rugosa.sources.sinks import read_metrics_csv, write_report

__all__ = [
    "clean_numeric",
    "lenient_double",
    "load_experiments_csv",
    "normalize_columns",
    "select_required",
    "load_table",
    "runs_from_lineitem",
    "read_metrics_csv",
    "write_report",
]
