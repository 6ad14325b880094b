"""Rare-event analytics and modelling on Spark DataFrames."""
