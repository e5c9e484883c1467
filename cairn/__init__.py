"""Cairn: file and document inventories at scale, as plain Spark DataFrame jobs."""
