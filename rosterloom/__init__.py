"""Catalog, availability and scheduling analytics as Spark DataFrame jobs.

Every operator takes DataFrames (plus column names or parameters) and returns a
DataFrame.  Nothing in the package collects a data-sized result to the driver.
"""
