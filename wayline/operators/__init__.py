"""Operators over detections, tracks and events."""
