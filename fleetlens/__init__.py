"""Transit telemetry analytics on Spark: telemetry -> events -> calibration -> scoring -> reports."""
