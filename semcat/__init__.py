"""Schema and code semantics mined from source files, as Spark DataFrames."""

from semcat.config import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
