"""pagelake: turn tables of raw web pages into clean, typed tables with Spark."""

__version__ = "0.1.0"
