"""Endpoint-behaviour analytics as Spark DataFrame transforms."""
