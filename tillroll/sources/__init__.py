"""Table readers, stand-in business tables and sinks."""

from . import standins
from .sinks import write_table
from .tables import DRIVER_TABLES, read_table

__all__ = ["DRIVER_TABLES", "read_table", "standins", "write_table"]
