"""cutline: timelines, frame tables and document metadata on Spark."""

__version__ = "0.1.0"
