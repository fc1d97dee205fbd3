"""textward: find, decide on and measure sensitive content in text tables with Spark."""

__version__ = "0.1.0"
