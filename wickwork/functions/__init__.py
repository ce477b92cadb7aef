"""Column vocabulary and recursive kernels."""
