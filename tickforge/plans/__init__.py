"""The expression graph of series operators and its compilers."""
