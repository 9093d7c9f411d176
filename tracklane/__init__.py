"""Spark analytics for behavioural and neural time series: DataFrame functions with the roles of columns as arguments."""
