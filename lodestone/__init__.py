"""Bytecode-corpus analytics and table kernels on PySpark."""
