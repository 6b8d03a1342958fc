"""Registered queries, the input views they read and their SQL twins."""
