"""Web-document analytics on Spark: tables in, tables out."""
