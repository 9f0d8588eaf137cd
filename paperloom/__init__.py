"""paperloom: a Spark-first engine for corpora of extracted office documents."""

__version__ = "0.1.0"
