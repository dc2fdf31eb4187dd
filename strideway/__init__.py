"""Strideway: hazard-fact analytics expressed as Spark DataFrame operators."""
