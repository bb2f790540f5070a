"""Reading and writing molecule tables, records, vocabularies and results."""
