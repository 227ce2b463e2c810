"""Telemetry analytics and forecasting on Spark."""
