"""Whole layers: bronze, silver, gold, and the queries over them."""
