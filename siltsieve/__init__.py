"""siltsieve: a Spark-native engine for profiling, normalising and cleaning semi-structured records."""

__version__ = "0.1.0"
