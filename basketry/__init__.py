"""basketry: retail recommendation and experimentation analytics as Spark DataFrame operators.

Every operator is a lazy function ``f(DataFrame, ..., params) -> DataFrame`` that works on all
users at once; nothing is collected to the driver and no Python runs per row.
"""

__version__ = "0.1.0"
