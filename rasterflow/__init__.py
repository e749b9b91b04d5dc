"""rasterflow: image analytics and conversion expressed as Spark DataFrame jobs."""
