"""Sensor-health analytics on Spark: windows, features, calibration, scores and metrics as DataFrame plans."""
