"""Dose and plan analytics as lazy Spark DataFrame operators."""
