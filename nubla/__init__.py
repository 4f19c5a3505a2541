"""Pseudonymisation of clinical notes and longitudinal tables as Spark DataFrame operators."""
