"""Reading and writing tables, models and small frames."""
