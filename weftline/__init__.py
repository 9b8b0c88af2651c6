"""weftline: a Spark-native engine that indexes a text or source corpus into files, symbols, edges and chunks."""
