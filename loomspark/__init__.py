"""loomspark: analytics operators written as Spark DataFrame plans."""
