"""lotline: analytics over trade fills of short-lived binary markets, on PySpark."""
