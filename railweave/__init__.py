"""railweave: transport-network analytics and data preparation on Spark DataFrames.

Every operator takes and returns DataFrames.  Importing the package loads no
optional subpackage: ``railweave.llm`` can be deleted without effect on the rest.
"""

__version__ = "0.1.0"
