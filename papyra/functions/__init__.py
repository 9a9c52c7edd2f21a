"""Scalar functions as Column expressions; nothing here runs Python on the executors unless it says so."""
