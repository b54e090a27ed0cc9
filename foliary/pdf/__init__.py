"""PDF syntax in plain Python: parsing, filters, encryption, text and writing. No Spark here."""
