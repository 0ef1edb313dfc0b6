"""Imagery-inspection analytics on Spark: images, labels, thermal planes, detections, map features and run logs as tables."""
