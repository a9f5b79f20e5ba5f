"""gristmill: a PySpark engine that grinds loose study tables and text into clean records."""
