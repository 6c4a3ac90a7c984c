"""sheafspark: pack collections of files into clean, measured XML bundles with Spark."""

from sheafspark.options import BundleOptions

__all__ = ["BundleOptions"]
__version__ = "0.1.0"
