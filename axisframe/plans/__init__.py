"""Plans that the driver makes before Spark runs them."""
