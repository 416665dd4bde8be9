"""Column functions: text repair, line tests, and the fixed values they use."""
