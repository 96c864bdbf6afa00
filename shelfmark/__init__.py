"""shelfmark: build a clean catalogue of listings from raw pages with Spark.

Every public function takes and returns DataFrames or Columns, so it composes
with ``df.transform`` and leaves the physical plan to Spark.
"""

from shelfmark.settings import SiteProfile

__all__ = ["SiteProfile"]
