"""hearth: household-budget case analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``); column names, code maps and limits are parameters whose
defaults live in :mod:`hearth.config`.
"""

__version__ = "0.1.0"
