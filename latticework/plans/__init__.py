"""Registered queries, tool functions and the command line."""
