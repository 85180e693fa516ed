"""Part of the profiling engine; see the package docstring."""
