"""Analytics on refinable cell grids, written as Spark DataFrame plans."""
