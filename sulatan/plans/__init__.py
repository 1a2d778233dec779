"""Derived inputs and the registered queries with their reference SQL."""
