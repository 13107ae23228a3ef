"""Reading and writing: file manifests, sidecars, station configs, tables and guides."""
