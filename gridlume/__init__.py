"""Spark-native analytics for finding out how images and video frames were resampled."""
