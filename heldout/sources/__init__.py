"""Table scans, sinks and the manifest of finished work."""
