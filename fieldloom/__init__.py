"""fieldloom: web pages to reviewed, searchable records as Spark jobs."""
