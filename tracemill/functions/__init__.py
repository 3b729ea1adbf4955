"""Expressions shared by the query modules."""
