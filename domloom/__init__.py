"""Web-corpus analytics on Spark: pages as node tables, selectors as plans, crawls as waves of joins."""

__version__ = "0.1.0"
