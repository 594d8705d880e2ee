"""Operators of a training-data pipeline over tables of documents and conversations."""
