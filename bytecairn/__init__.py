"""Analytics and batch processing for object-store catalogues, and training-data operators, on Spark."""
