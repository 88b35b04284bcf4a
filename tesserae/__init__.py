"""Retrieval and data-preparation engine expressed on the Spark DataFrame API."""
