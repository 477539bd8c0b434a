"""Queries over the given tables that apply the operators, with SQL that gives the same rows."""
