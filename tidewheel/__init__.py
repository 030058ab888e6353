"""Recurring-event calendars as Spark DataFrames, with a query language over their occurrences."""
