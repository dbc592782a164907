"""lectern: a PySpark-native engine for catalogues and full texts of document collections."""
