"""terrane: estate graph analytics and table reconciliation on Spark DataFrames."""
