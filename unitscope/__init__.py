"""Calibrated anomaly analytics and training-data operators as plain PySpark DataFrame functions."""
