"""Operators of a training-data pipeline over text, web pages and vectors."""
