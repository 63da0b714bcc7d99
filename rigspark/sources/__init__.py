"""Readers and writers for footage files, rigs and calibration tables."""
