"""geomill: map, network, raster and asset analytics as Spark jobs."""
