"""tabulens: exploratory analysis of flat tables on PySpark, with every number from a recorded computation."""
