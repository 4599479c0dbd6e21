"""quantloom: portfolio research on market data as Spark plans."""
