"""Mobility analytics on Spark."""
