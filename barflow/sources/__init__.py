from barflow.sources.tables import load
