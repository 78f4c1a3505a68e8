"""Vestigo: plate-evidence analytics expressed as Spark DataFrame jobs."""
