"""Column-level building blocks (strings, arrays, bags of tokens, Arrow helpers)."""
