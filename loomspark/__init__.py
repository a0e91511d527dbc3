"""Spark-native text-corpus construction, candidate selection and reference-based evaluation."""
