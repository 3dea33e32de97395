"""Scalar and vector functions: Column expressions, and plane geometry on the driver."""
