"""Scalar helpers, NumPy kernels and SQL registration."""
