"""Column expressions: the kernels of the library."""
