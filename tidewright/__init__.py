"""Tidewright: ordered event pipelines and an event archive on Spark."""
