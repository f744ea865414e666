"""notelake: a Spark-native engine for searching, checking and preparing collections of notes."""
