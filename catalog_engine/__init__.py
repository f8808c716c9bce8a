"""Item-catalogue toolkit on PySpark: clean, embed, search, recommend, upsert."""
