"""Graph, series, spatial, raster and asset operators: DataFrame in, DataFrame out."""
