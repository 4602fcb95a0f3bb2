"""Column functions with the semantics of IEEE arithmetic and of fixed-width integers."""
