"""DataFrame operators on temporal property graphs."""
