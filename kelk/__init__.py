"""kelk: a Spark-first engine for cleaning, consolidating and monitoring user-generated text and events."""

__version__ = "0.1.0"
