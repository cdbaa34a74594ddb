"""corpusloom: a PySpark engine that turns version-control history and raw text into clean training corpora."""
