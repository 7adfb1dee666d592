"""Site-audit analytics on PySpark: pages, links and sitemaps in, audited and compared runs out."""

__version__ = "0.3.0"
