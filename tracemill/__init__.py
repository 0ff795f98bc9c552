"""Tracemill: location-history analytics and corpus preparation as Spark DataFrame operators."""
