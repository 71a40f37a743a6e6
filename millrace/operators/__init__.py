"""Relational operators that Spark SQL does not express by itself, and the fluent interface."""
