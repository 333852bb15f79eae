"""Whole queries: operators over the tables, each with its SQL."""
