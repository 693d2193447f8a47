"""Document-text engine on PySpark: word tables, lexicons, look-alike repair, rows, receipts and scores."""

__version__ = "0.1.0"
