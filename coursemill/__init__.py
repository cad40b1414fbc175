"""coursemill: a PySpark-native engine for course-knowledge collections."""
