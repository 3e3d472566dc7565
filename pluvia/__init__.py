"""Bias-corrected precipitation forecasts as Spark DataFrame operators."""
