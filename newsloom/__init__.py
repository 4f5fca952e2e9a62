"""Analytics over large streams and corpora of short documents, as PySpark jobs."""
