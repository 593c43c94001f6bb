"""tessera: temporal property graphs with uncertainty, on PySpark."""
