"""Spark-native tissue transport analytics: grids, vessel graphs and their coupling as DataFrames."""
