"""The book built from the driver tables, the registered queries and their SQL."""
