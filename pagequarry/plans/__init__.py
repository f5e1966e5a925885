"""Compositions of operators: the page report and the registered queries."""
