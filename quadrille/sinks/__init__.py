"""Sinks of tilesets: Parquet by zoom, XYZ trees and MBTiles files, and Cloud Optimized GeoTIFF."""
