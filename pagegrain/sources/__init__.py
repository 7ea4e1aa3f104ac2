"""Reading and writing stores, CSV and schema definitions."""
