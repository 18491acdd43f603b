"""Typed queries over the tables: the catalog binds each operator to data and to its SQL."""
