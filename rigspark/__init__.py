"""PySpark-native operators for multi-camera footage, calibration tables and event streams."""
