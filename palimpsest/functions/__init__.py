"""Scalar functions: protocol bytes as hex strings, all of them Catalyst expressions."""
