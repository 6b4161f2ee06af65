"""PySpark-native analytics for logs, traces, documents, catalogs and graphs."""
