"""terrafold: agro-climatic raster, zonal and entity analytics as Spark jobs."""
