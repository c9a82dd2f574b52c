"""Scalar, aggregate and window functions as Column builders."""
