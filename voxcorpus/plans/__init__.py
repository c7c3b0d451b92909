"""Whole plans built of the operators, and the queries of the driver."""
