"""Operators for training-data tables and their registered queries.

Nothing outside this subpackage imports it. Python code that runs in tasks is
shipped by value, so executors need the libraries but not this repository.
"""
