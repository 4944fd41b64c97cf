"""Spark-native media analytics: containers, codecs, pixels and metadata as DataFrames."""
