"""Column expressions. Each takes columns or names and returns a column; none needs Python on the executors unless it says so."""
