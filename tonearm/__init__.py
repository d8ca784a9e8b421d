"""tonearm: a Spark-native analytics engine for audio-library metadata."""
