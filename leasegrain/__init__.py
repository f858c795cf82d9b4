"""leasegrain: comparable-listings analytics as Spark jobs.

Raw rental-listing pulls become one row per continuous vacancy ("comps"); a
table of pricing requests is then derived against those comps in one pass.
Every operator is a function from DataFrames to DataFrames and runs no action.
"""

from leasegrain.config import Knobs

__all__ = ["Knobs"]
