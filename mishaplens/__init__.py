"""Incident-diagnosis analytics on Spark: declarative DataFrame operators, sources, plans and streaming."""
