"""marlstone: Spark-native behaviour, retrieval and corpus analytics."""
