"""Tremor: stress testing and pivot analytics of position books on Spark."""
