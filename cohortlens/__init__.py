"""Cohort, feature, label and ranking operators on Spark DataFrames."""
