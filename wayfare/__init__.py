"""Travel-trajectory and airway-network analytics on Spark DataFrames."""
