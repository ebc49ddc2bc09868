"""Operators over tables of offers, prices, watches and reviews."""
