"""webwarden: Spark-native analytics over URLs, pages, certificates, logs and texts."""
