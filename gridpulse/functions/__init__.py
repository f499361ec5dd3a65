"""Reusable Column builders (no UDFs): categories, labels, predicates, filters."""
