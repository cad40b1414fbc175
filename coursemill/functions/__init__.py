"""Column functions and vectorised text kernels."""
