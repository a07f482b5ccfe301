"""footfall: pedestrian-flow analytics and corpus operators on PySpark."""
