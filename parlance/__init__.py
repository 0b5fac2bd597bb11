"""Signed discourse analytics expressed as Spark DataFrame plans."""
