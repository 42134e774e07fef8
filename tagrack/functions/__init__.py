"""Column-level helpers: text folding and skew-safe ranking."""
