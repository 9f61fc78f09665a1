"""quillon: bibliometric analytics on PySpark."""
