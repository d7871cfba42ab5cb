"""Telemetry analytics for a fleet of database servers, written as Spark DataFrame jobs."""
