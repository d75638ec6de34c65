"""A spatial, network and tabular analytics engine declared on PySpark DataFrames."""

from lodestone.frame import Frame, Table
from lodestone.session import session
from lodestone.sources.data import read_data, write_data

__version__ = "0.2.0"
__all__ = ["Frame", "Table", "read_data", "session", "write_data"]
