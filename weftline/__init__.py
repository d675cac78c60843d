"""weftline: a PySpark-native analytics engine for code knowledge graphs and agent transcripts."""
