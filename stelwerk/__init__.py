"""stelwerk: a Spark-first engine for raw legal records, the graph built from them, and training text.

Everything is a function from DataFrames to a DataFrame. Most only make a plan; those that write tables in between, as their
docstrings say, run jobs while it is made. The subpackage ``llm`` holds the text operators and is imported by nothing else
in the library.
"""

__version__ = "0.1.0"
