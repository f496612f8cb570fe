"""Keyed fact stores on Spark and the confidence of answers drawn from them."""
