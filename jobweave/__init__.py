"""PySpark-native engine for opportunity listings: ingest, gate, classify, resolve, merge, serve, analyse."""
