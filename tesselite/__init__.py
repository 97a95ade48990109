"""tesselite: declarative mapping of records to linked-data entities on PySpark."""

__version__ = "0.1.0"
